"""Look-alike text, token ids, leaked passages and sentences: round trips, brute force and awkward rows."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listwright.functions.charfold import fold
from listwright.llm import bpe, leakage
from listwright.llm.glyphs import canonical_text, look_alike_pairs
from listwright.llm.queries import PRE_TOKENS, VOCABULARIES
from listwright.llm.sentences import boundaries, sentences


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


NAMES = ["Salt 1 kg", "Ｓａｌｔ １ ｋｇ", "Sаlt 1 kg", "Sa​lt 1 kg ", "salt 1 kg", "Salt 1kg", "½ kg", "1/2 kg", "Rosé", "Rosé", "Rose", "oﬀer", "offer", None, "", " 　", "K", "K", "x" * 100_000]


def test_forms(spark):
    df = spark.createDataFrame(list(enumerate(NAMES)), "k int, name string")
    got = {r.k: r.form for r in canonical_text(df, "name").collect()}
    assert [got[k] for k in range(len(NAMES))] == [fold(n) for n in NAMES]
    assert got[0] == got[1] == got[2] == got[3] != got[4]
    assert got[5] != got[0] and got[6] != got[7] and got[8] == got[9] != got[10] and got[11] == got[12]
    assert got[13] is None and got[14] == got[15] == ""


@settings(max_examples=60)
@given(st.text(max_size=40))
def test_folding_twice_changes_nothing(text):
    assert fold(fold(text)) == fold(text)


def test_pairs(spark):
    data = [*((k, n) for k, n in enumerate(NAMES)), (0, NAMES[0]), (100, NAMES[0]), (None, NAMES[1])]
    got = rows(look_alike_pairs(spark.createDataFrame(data, "k bigint, name string"), "k", "name"))
    want = set()
    rows_ = sorted({(k, n) for k, n in data if k is not None and n is not None})
    for k, a in rows_:
        for m, b in rows_:
            if k < m and a != b and fold(a) == fold(b):
                want.add((k, m))
    assert set(got) == want and len(got) == len(want)
    empty = spark.createDataFrame([], "k bigint, name string, form string, t string")
    assert rows(look_alike_pairs(empty, "k", "name")) == []


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "old")], "i int, name string, form string")
    assert canonical_text(df, "name").columns == ["i", "name", "form"]


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{VOCABULARIES}/byte_bpe_50k.json"
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t, bpe.load(path)


TEXTS = ["Hello world", "", None, "<|endoftext|> a", "naïve café ½ kg — “x”", "ताज़ा आटा", "这款面粉重10.6公斤。", "a" * 3000, " " * 2000 + "x", "\r\n\t \n", "don't we'll I'VE", "👩‍🍳 ok", "\x00\x1c\x85"]


def test_ids_equal_the_library(vocabulary):
    library, table = vocabulary
    got = bpe.encode_texts(TEXTS, table, PRE_TOKENS).to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(vocabulary, text):
    library, table = vocabulary
    ids = bpe.encode_texts([text], table, PRE_TOKENS).to_pylist()[0]
    assert library.decode(ids, skip_special_tokens=False) == text


def test_perfect_hash():
    entries = {f"w{k}".encode(): k for k in range(5000)}
    h = bpe.PerfectHash(entries)
    assert sorted(h.keys) == sorted(entries)
    assert all(h.get(k) == v for k, v in entries.items())
    assert h.get(b"absent") is None
    assert bpe.PerfectHash({}).get(b"x") is None


def test_ids_of_rows(spark, vocabulary):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(0, "Hello world", 1)], "k bigint, text string, ids int")
    got = bpe.token_ids(df, "k", "text", f"{VOCABULARIES}/byte_bpe_50k.json", PRE_TOKENS)
    assert got.count() == len(TEXTS) + 1
    assert {r.k: r.ids for r in got.collect()}[2] == []
    assert bpe.token_ids(df.where("false"), "k", "text", f"{VOCABULARIES}/byte_bpe_50k.json", PRE_TOKENS).count() == 0


WORDS = [f"word{k}" for k in range(60)]


def _brute(docs, items):
    out = set()
    for i, lang, text in items:
        kind = "char" if lang in ("zh", "ja") else "word"
        n = leakage.SPAN[kind]
        u = leakage.units(leakage.plain_text(text or ""), kind)
        grams = {tuple(u[k : k + n]) for k in range(len(u) - n + 1)}
        for d, t in docs:
            v = leakage.units(leakage.plain_text(t or ""), kind)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return sorted(out, key=repr)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    cjk = lambda n: "".join(rng.choice("请判断标题与罐装是否指向同一个物件如果没有写明产地而") for _ in range(n))
    items = [(k, "en", text(40)) for k in range(8)] + [(50 + k, "zh", cjk(60)) for k in range(4)] + [(90, "en", None), (91, "en", "short"), (92, "ja", ""), (0, "en", text(30))]
    docs = [(0, None), (1, ""), (2, "w " * 50_000)]
    for d in range(3, 60):
        i = rng.choice([x for x in items if x[2] and len(x[2]) > 50])
        if i[1] == "en":
            w = i[2].split()
            n = rng.randint(9, 16)
            a = rng.randint(0, len(w) - n)
            piece = rng.choice([" ", "\n", " **", ", ", " "]).join(w[a : a + n])
            piece = rng.choice([str.upper, str, lambda s: s.replace("o", "о"), lambda s: s.replace("w", "<b>w", 1), lambda s: "​".join(s)])(piece)
        else:
            n = rng.randint(20, 28)
            a = rng.randint(0, len(i[2]) - n)
            piece = rng.choice(["", "，", " "]).join(i[2][a : a + n])
        docs.append((d, f"{text(15)} {piece} {text(12)}"))
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, lang string, text string"), "doc_id", "text", "item_id", "text", "lang")
    assert rows(got) == _brute(docs, items)


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "en", " ".join(WORDS))], "item_id bigint, lang string, text string")
    assert rows(leakage.leaked_items(docs, items, "doc_id", "text", "item_id", "text", "lang")) == []
    docs = spark.createDataFrame([(1, " ".join(WORDS), 1)], "doc_id bigint, text string, item int")
    assert rows(leakage.leaked_items(docs, items.where("false"), "doc_id", "text", "item_id", "text", "lang")) == []
    assert rows(leakage.leaked_items(docs, items, "doc_id", "text", "item_id", "text", "lang")) == [(1, 1)]


def test_text_in_angle_brackets_is_no_tag(spark):
    passage = " ".join(WORDS[:14])
    docs = [(1, f"grade <A {passage}> end"), (2, f"<p class='x'>{passage}</p>"), (3, passage.replace(" ", " <b>", 1).replace(" ", " </b>", 2)), (4, f"<!-- {passage} -->"), (5, passage.replace(" ", " <!-- x --> ", 3)), (6, f"<{passage}>"), (7, "<p hidden><img src=a.png alt='two words'/>")]
    items = spark.createDataFrame([(1, "en", passage)], "item_id bigint, lang string, text string")
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items, "doc_id", "text", "item_id", "text", "lang")
    assert rows(got) == [(k, 1) for k in range(1, 7)]
    assert leakage.plain_text(docs[6][1]).split() == []


def test_repeated_passages_cost_a_row_per_diagonal(spark):
    item = " ".join(WORDS[:8] * 5)
    docs = [(1, " ".join(WORDS[:8] * 3000)), (2, " ".join([*WORDS[:8], "x"] * 3000))]
    items = spark.createDataFrame([(1, "en", item), (2, "en", item)], "item_id bigint, lang string, text string")
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items, "doc_id", "text", "item_id", "text", "lang")
    assert rows(got) == [(1, 1), (1, 2)]


@pytest.mark.parametrize("bound", [leakage.BROADCAST_BYTES, 0])
def test_hits_and_sides_beyond_the_bound_stay_off_the_driver(spark, monkeypatch, bound):
    plans, store = [], leakage.stored

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(leakage, "stored", noted)
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", bound)
    docs, items = [(k, " ".join(WORDS[k : k + 13])) for k in range(40)], [(k, "en", " ".join(WORDS[k : k + 20])) for k in range(0, 40, 3)]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, lang string, text string"), "doc_id", "text", "item_id", "text", "lang")
    assert rows(got) == _brute(docs, items)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 2 and ("Broadcast" in plans[1]) == (bound > 0)


SENTENCES = [
    ["Dr. Hazu from Kelonda Pvt. Ltd. checked batch no. 17 twice.", "It costs Rs. 50.50 at most shops, incl. taxes."],
    ['"Is it fresh?" asked the buyer.', 'The seller answered, "We ship on Monday."', "U.S. buyers paid more than E.U. buyers did."],
    ["At 10 a.m. Chibo's counter had none.", "Delivery came at 9 p.m.", "It weighs 5.5 kg, i.e. more."],
    ["Well... it is bright, but not bad.", "I waited 73 days...", "The taste fades… and then it returns."],
    ["(The lid was missing.)", "The cap (see fig. 5.3) fits tightly.", "Really?!", "Keep the lid shut!!"],
    ["eVifesa pods dissolve in cold water.", "Who prints \"new!\" on a fresh pouch?"],
    ["Lieferung am 3. Mai, bzw. 81 Tage später.", "Das Produkt hält z. B. im Kühlschrank.", "„Schmeckt gut“, schrieb eine Kundin."],
    ["Le vendeur écrit : « Livré lundi. »", "Pourquoi deux noms pour un seul sachet ?", "Mme Rumi préfère la crème, p. ex. au petit déjeuner."],
    ["¿Es el mismo artículo que el núm. 86?", "El precio subió 1,5 % en EE. UU. durante el verano.", "El sabor es suave; el olor, no.", "«Llegó tarde», escribió."],
    ["क्या यह 3.5 कि.ग्रा. का पैक है?", "कीमत रु. 12.50 है।", '"यह ताज़ा है?" उसने पूछा।', "ढक्कन ढीला था… फिर भी कुछ नहीं गिरा।"],
    ["د. مرزوان راجع الملصق مرتين.", "الطعم جيد جدا!", "يباع في عبوات 0.5 لتر، 1 لتر، إلخ.", "هل هذا هو المنتج؟"],
]
UNSPACED = [
    ["客服说“明天发货。”之后再没有消息。", "总的来说，还行吧……不过不会再买。", "收到43件，其中9件有划痕……", "盖子松了。"],
    ["店主は「来週また入ります。」とだけ言いました。", "味はとても良いです！", "箱に「2.5kg」と書いてあります。"],
]


@pytest.mark.parametrize("parts", SENTENCES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\n\n", "\r\n \r\n"])
def test_sentences(parts, gap):
    text = gap.join(parts)
    assert [text[a:b] for a, b in boundaries(text)] == parts


@pytest.mark.parametrize("parts", UNSPACED)
def test_sentences_without_blanks(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in boundaries(text)] == parts


def test_lower_case_text_with_another_text_inside():
    parts = ["we weighed it at 3.4 kg, i.e. more.", "the seller answered, \"we ship on monday.\"", "it is sold by kelvane pvt. ltd.", "loved it!", "Compare Gobubati and say so."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in boundaries(text)] == parts


def test_thai_blanks_headings_and_missing_blanks():
    text = "ร้านนี้ส่งของเร็วมากค่ะ ฉลากเขียนว่า 2.5 กก. แต่ชั่งได้น้อยกว่านั้น"
    assert [text[a:b] for a, b in boundaries(text)] == ["ร้านนี้ส่งของเร็วมากค่ะ", "ฉลากเขียนว่า 2.5 กก. แต่ชั่งได้น้อยกว่านั้น"]
    text = "Notes on batch 84\n \nA line\nbroken here.Do not store."
    assert [text[a:b] for a, b in boundaries(text)] == ["Notes on batch 84", "A line\nbroken here.", "Do not store."]


def test_case_is_judged_by_whole_paragraphs():
    tail = "यह सूची 2024. new item is here"
    parts = lambda text: [text[a:b] for a, b in boundaries(text)]
    assert parts(tail) == ["यह सूची 2024.", "new item is here"]
    for before in ("सूची " * 130, "Capitals Here. And There."):
        assert parts(f"{before.strip()}\n\n{tail}")[-2:] == ["यह सूची 2024.", "new item is here"]
    assert parts("It came p. ex." + " " * 90 + "then went.") == ["It came p. ex." + " " * 90 + "then went."]


def test_list_levels():
    parts = lambda text: [text[a:b] for a, b in boundaries(text)]
    assert parts("In the box: 1. Rice 2. Dal 3. Salt") == ["In the box: 1. Rice 2. Dal 3. Salt"]
    assert parts("Steps: 1. Wash. A. Cold water 2. Dry it. We sold 7. Then more.") == ["Steps: 1. Wash.", "A. Cold water 2. Dry it.", "We sold 7.", "Then more."]
    assert parts("We sold 1. Then we sold 2. Then none.") == ["We sold 1.", "Then we sold 2.", "Then none."]
    assert parts("Only: 1. Rice\n\nLater we sold 2. Then none.") == ["Only: 1. Rice", "Later we sold 2.", "Then none."]


@pytest.mark.parametrize("unit", ["foo.) bar(x) ", "a. ", "1. ", "“x” ", "www.a.b ", "«a. ", "... ", '. "', "न. ", "ltd. ", "9 a.m. ", "(b. ", "é.A", "ab"])
def test_long_texts_take_linear_time(unit):
    text = unit * (200_000 // len(unit))
    begun = time.process_time()
    boundaries(text)
    assert time.process_time() - begun < 10  # quadratic ways took 30 to 190 s


@settings(max_examples=200)
@given(st.text(alphabet=st.sampled_from(list(' \n\tab.A!?"“”«»()…。」「ก.5,|')), max_size=60))
def test_sentences_cover_all_but_white_space(text):
    at = 0
    for a, b in boundaries(text):
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_sentence_rows(spark):
    data = [(1, "Ab cd. Ef gh."), (2, None), (3, ""), (4, " \n "), (5, "x " * 50_000), (1, "Ab cd. Ef gh.")]
    got = sentences(spark.createDataFrame(data, "doc_id bigint, text string"), "doc_id", "text")
    assert rows(got) == [(1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13), (5, 0, 99_999)]
    assert sentences(spark.createDataFrame([], "doc_id bigint, text string, sent_end int"), "doc_id", "text").count() == 0
