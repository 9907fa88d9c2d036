"""Product groups, connected groups and surviving values: brute force and awkward rows."""

import datetime as dt
import random

import pytest

from listwright.llm import attributes
from listwright.llm.components import connected_components, member_edges
from listwright.llm.linkage import fit_weights, product_groups, product_pairs
from listwright.llm.vocabulary import word_roles
from listwright.llm.survivors import clear_fields, cut_off, layers, shown_parts, survivors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _groups(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    links += [(1000 + k, 1001 + k) for k in range(200)]  # a chain
    links += [(1100, 2000 + k) for k in range(150)]  # a hub on the chain
    links += [(None, 5), (7, None), (9, 9), (1100, 2000), (2000, 1100)]
    rng.shuffle(links)
    got = {r.id: r.group_id for r in connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == _groups(links)


def test_components_of_nothing(spark):
    assert rows(connected_components(spark.createDataFrame([], "u bigint, v bigint"))) == []
    assert rows(connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u bigint, v bigint"))) == []
    assert rows(connected_components(spark.createDataFrame([(2, 1)], "u bigint, v bigint"))) == [(1, 1), (2, 1)]


def test_member_edges(spark):
    df = spark.createDataFrame([(1, [5, 3, 3, None, 9]), (2, []), (3, None), (4, [7])], "cluster_id int, ids array<bigint>")
    assert rows(member_edges(df, "ids")) == [(3, 5), (3, 9)]


@pytest.mark.parametrize(
    ("name", "kind", "variant", "amount", "packs", "added"),
    [
        ("Mechabrinai Gulab Jal (Lavender) 100 ML [Pack of 3]", "rose water", "lavender", ("ml", 100.0), [3], ""),
        ("ＮＯＲＶＡＮＥ　ＧＯＺＥＲＡＴＵ　ＫＡＤＨＡＩ　－　ＭＡＲＯＯＮ", "kadhai", "maroon", None, [], ""),
        ("Salted Peanut Butter Kigaifaigi 16 ounces", "peanut butter", "salted", ("g", 453.59237), [], ""),
        ("Gold Vachohaifu Makkhan 5 kilo x 12", "salted butter", "gold", ("g", 5000.0), [12], ""),
        ("Kedubregu Wireeless Ruter Model T20", "wireless router", "t20", None, [], ""),
        ("Frying Pan Shogaimehe Blue Navy 15 सेमी", "fry pan", "navy blue", ("cm", 15.0), [], ""),
        ("Pachutashu Bath Soap - 2 in 1, 70 grams + Body Mist 100 ml", "bath soap", "2 1", ("g", 70.0), [], "body mist 100 ml"),
        ("TOP RATED* Kumarelo Fabric Softener - SPF 50", "fabric conditioner", "spf 50", None, [], ""),
        (None, None, "", None, [], ""),
        ("", None, "", None, [], ""),
    ],
)
def test_attributes(name, kind, variant, amount, packs, added):
    got = attributes.read(name)
    assert got[:2] == (kind, variant)
    assert (got[2] and (got[2][0], round(got[2][1], 6))) == amount
    assert got[3:5] == (packs, added)


def _patterns():
    """Patterns of 8 fields with 100 lines of 10 products in 4 listings, of which one in five differs in one field from a sister."""
    full = [2, 2, 2, 2, None, 2, 2, None]
    one = lambda k, x: tuple(x if i == k else v for i, v in enumerate(full))
    pairs = 100 * 40 * 39 / 2
    patterns = [(tuple(full), 6000.0), (one(3, 0), 4000.0), (one(5, 0), 5000.0), (one(6, 0), 3000.0), (one(3, 1), 40.0), (one(2, None), 30.0), (one(0, 0), 50.0), (one(0, 1), 20.0)]
    share = {"line": 1.0, "brand": 1.0, "kind": 0.3, "variant": 0.25, "terms": 0.0, "amount": 0.25, "pack": 0.4, "article": 0.0}
    chance = {("line", f): (pairs, 0.0 if f in ("terms", "article") else pairs, x * pairs) for f, x in share.items()}
    wide = {"line": 0.01, "brand": 1.0, "kind": 0.03, "variant": 0.03, "terms": 0.0, "amount": 0.03, "pack": 0.35, "article": 0.0}
    chance |= {("brand", f): (100 * pairs, 0.0 if f in ("terms", "article") else 100 * pairs, x * 100 * pairs + share[f] * pairs) for f, x in wide.items()}
    return patterns, chance, one, tuple(full)


def test_weights_separate_matches():
    patterns, chance, one, full = _patterns()
    post = fit_weights(patterns, chance)
    assert post[full] > 0.95 and post[one(2, None)] > 0.5
    assert all(post[one(k, 0)] < 0.5 for k in (0, 3, 5, 6))
    assert post[one(3, 1)] > post[one(3, 0)] and post[one(0, 1)] > post[one(0, 0)]
    loose = fit_weights(patterns, chance, slip=0.5)
    assert any(loose[one(k, 0)] > 0.5 for k in (3, 5, 6))  # the bound on reading errors tells the classes apart
    assert fit_weights([], {}) == {}


LISTING = "row_id bigint, product_name string, brand string, quantity string, qty_value double, qty_unit string"
ROWS = [
    (1, "Norvane Taihostibra Hand Wash Rose 500 ml", "Norvane", None, None, None),
    (2, "taihostibra liquid handwash (rose) 0.5 ltr NORVANE", "norvane", None, None, None),
    (3, "Taihostibra Hand Wash - Rose", "Norvane", "Net 500ml", None, None),
    (4, "Taihostibra Hand Wash Rose", "N/A", None, 50.0, "cl"),
    (5, "Taihostibra Hand Wash Rose 250 ml", "Norvane", None, None, None),
    (6, "Taihostibra Hand Wash Neem 500 ml", "Norvane", None, None, None),
    (7, "Taihostibra Hand Wash Rose 500 ml Pack of 2", "Norvane", None, None, None),
    (8, "Taihostibra Hand Wash Rose 500 ml + Body Mist 100 ml", "Norvane", None, None, None),
    (9, "Taihostibra Shampoo Rose 500 ml", "Norvane", None, None, None),
    (10, "Gozeratu Hand Wash Rose 500 ml", "Kelvane", None, None, None),
    (11, None, None, None, None, None),
    (12, "", "Norvane", None, None, None),
    (13, "Taihostibra Hand Wash Rose 508 ml", "Norvane", None, None, None),
    (None, "Taihostibra Hand Wash Rose 500 ml", "Norvane", None, None, None),
    (1, "Norvane Taihostibra Hand Wash Rose 500 ml", "Norvane", None, None, None),
]


def test_products(spark):
    groups = product_groups(spark.createDataFrame(ROWS, LISTING), "row_id")
    got = {r.row_id: r.group_id for r in groups.collect()}
    assert {got[k] for k in (1, 2, 3, 4, 13)} == {1}
    assert len({got[k] for k in (1, 5, 6, 7, 8, 9, 10)}) == 7
    assert got[11] == 11 and got[12] == 12
    assert rows(product_pairs(groups, "row_id")) == sorted(((a, b) for a in (1, 2, 3, 4, 13) for b in (1, 2, 3, 4, 13) if a < b), key=repr)


def test_constant_weights_change_the_groups(spark):
    df = spark.createDataFrame(ROWS, LISTING)
    flat = product_groups(df, "row_id", weights=lambda patterns, chance: dict.fromkeys((p for p, _ in patterns), 1.0))
    got = {r.row_id: r.group_id for r in flat.collect()}
    assert len({got[k] for k in (1, 5, 6, 7, 8)}) == 1  # every pair of a block is then a link


def _tools(rng):
    """(row, product) of listings of goods that no lexicon knows: other wordings, order, case, units and spelling slips."""
    kinds = [["impact drill", "drill machine"], ["angle grinder", "grinding tool"], ["garden hose", "watering pipe"], ["work gloves", "safety mitts"], ["jig saw", "curve cutter"], ["paint roller", "wall brush"]]
    brands = ["Boskar", "Makrit", "Hilvo", "Dewent", "Ryovi", "Stanwik"]
    colours, out, row = ["azure", "crimson", "ochre", "umber"], [], 0
    for b, brand in enumerate(brands):
        for n in range(8):
            line = "".join(rng.choice(["zu", "ka", "ri", "mo", "te", "la", "vo", "pi"]) for _ in range(4)) + "xyzwvutr"[n]
            for product, (kind, colour) in enumerate([(kinds[(b + n) % 6], colours[n % 4]), (kinds[(b + n) % 6], colours[(n + 1) % 4]), (kinds[(b + n + 2) % 6], colours[n % 4])]):
                grams = rng.choice([250, 500, 750, 1250])
                for _ in range(6):
                    words = rng.choice(kind)
                    if rng.random() < 0.06:
                        k = rng.randrange(1, len(words) - 1)
                        words = words[:k] + words[k] * 2 + words[k + 1 :]
                    parts = [brand, line, words, colour]
                    rng.shuffle(parts)
                    size = rng.choice([f"{grams} g", f"{grams / 1000} kg", f"{grams * 1000} mg"])
                    name = " ".join([*parts, size])
                    out.append((row, rng.choice([str, str.upper, str.lower])(name), brand if rng.random() < 0.9 else None, None, None, None, (brand, line, product)))
                    row += 1
    return out


def test_products_of_unseen_kinds_without_a_lexicon(spark):
    data = _tools(random.Random(5))
    df = spark.createDataFrame([r[:6] for r in data], LISTING)
    true = {(a[0], b[0]) for i, a in enumerate(data) for b in data[i + 1 :] if a[6] == b[6]}
    for known in (False, True):
        got = {tuple(r) for r in product_pairs(product_groups(df, "row_id", known=known), "row_id").collect()}
        assert len(got & true) / len(true) >= 0.9 and len(got & true) / len(got) >= 0.9


def test_roles_of_words(spark):
    parsed = [("boskar", "zuka drill azure"), ("boskar", "zuka dril azure"), ("makrit", "rimo drill"), ("hilvo", "lavo drill makrit"), *[("hilvo", f"lavo{k} drill") for k in "abcdefghi"], (None, ""), (None, None)]
    got = {r.w: (r.role, r.to) for r in word_roles(spark.createDataFrame(parsed, "brand string, over string")).collect()}
    assert got["drill"] == ("term", "drill") and got["dril"] == ("line", "dril") and got["makrit"][0] == "brand" and got["zuka"][0] == "line"
    assert rows(word_roles(spark.createDataFrame([], "brand string, over string"))) == []


def test_products_of_an_empty_table(spark):
    assert rows(product_groups(spark.createDataFrame([], LISTING + ", line string, id bigint"), "row_id")) == []


def test_copies_of_one_listing_form_one_group(spark):
    df = spark.range(2000).selectExpr("id AS row_id", "'Taihostibra Hand Wash Rose 500 ml' AS product_name", "'Norvane' AS brand", "CAST(NULL AS STRING) AS quantity", "CAST(NULL AS DOUBLE) AS qty_value", "CAST(NULL AS STRING) AS qty_unit")
    got = product_groups(df, "row_id")
    assert got.select("group_id").distinct().count() == 1 and got.count() == 2000


def test_layers():
    assert layers([(1, 5), (2, 4), (1, 4), (0, 0), (1, 5)]) == [0, 0, 1, 2, 0]
    assert layers([]) == []


T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)
RECORD = "g bigint, brand string, category string, at timestamp, rank int"


def test_survivors(spark):
    data = [
        (1, "old", None, T0, 1), (1, "new", "n/a", T0 + DAY, 1), (1, None, "cat", T0, 3),
        (2, "a", "x", T0 + DAY, 5), (2, "b", "x", T0, 1),
        (3, "same", "y", T0, 1), (3, "same", "y", T0 + DAY, 1),
        (4, None, " ", T0, 1), (4, "-", None, None, None),
        (5, "tie1", "z", T0, 1), (5, "tie2", "z", T0, 1),
        (None, "x", "x", T0, 1),
    ]
    got = {(r.g, r.field_name): (r.field_value, r.clear, r.varied) for r in survivors(spark.createDataFrame(data, RECORD), "g", ["brand", "category"], "at", "rank").collect()}
    assert got[1, "brand"] == ("new", True, True)
    assert got[1, "category"] == ("cat", True, True)
    assert got[2, "brand"][1] is False and got[2, "category"] == ("x", False, False)
    assert got[3, "brand"] == ("same", True, False)
    assert got[4, "brand"][0] is None and got[4, "category"][:2] == (None, False)
    assert got[5, "brand"][1] is False and got[5, "category"] == ("z", True, False)
    assert {g for g, _ in got} == {1, 2, 3, 4, 5}


def test_nulls_are_filled_from_later_layers(spark):
    data = [(1, "top", None, T0 + DAY, 1), (1, None, "deep", T0 - DAY, 9), (1, "mid", "mid", T0, 5)]
    got = {r.field_name: (r.field_value, r.layer) for r in survivors(spark.createDataFrame(data, RECORD), "g", ["brand", "category"], "at", "rank").collect()}
    assert got["brand"] == ("top", 0)
    assert got["category"][0] == "mid"


def test_the_policy_decides_within_a_layer(spark):
    data = spark.createDataFrame([(1, "trusted", None, T0, 1), (1, "recent", None, T0 + DAY, 5), (1, "whole", "c", T0 - DAY, 9)], RECORD)
    by = lambda *policy: {r.field_name: r.field_value for r in survivors(data, "g", ["brand", "category"], "at", "rank", policy).collect()}
    assert by("trust", "recency", "completeness") == {"brand": "trusted", "category": "c"}
    assert by("recency", "trust", "completeness") == {"brand": "recent", "category": "c"}
    assert by("completeness", "trust", "recency") == {"brand": "whole", "category": "c"}


def test_a_record_without_the_field_hides_none_that_has_it(spark):
    data = spark.createDataFrame([(1, None, "r", T0 + 2 * DAY, 1), (1, "late", None, T0 + DAY, 2), (1, "whole", "m", T0, 5)], RECORD)
    got = {r.field_name: (r.field_value, r.clear) for r in survivors(data, "g", ["brand", "category"], "at", "rank").collect()}
    assert got == {"brand": ("late", True), "category": ("r", True)}


def test_the_policy_changes_clear_fields(spark):
    name = "Taihostibra Hand Wash Rose 500 ml"
    clusters = spark.createDataFrame([(1, [1, 2], [name], f"Norvane {name}", None)], "cluster_id bigint, member_ids array<bigint>, members array<string>, medoid_name string, llm_name string")
    listings = spark.createDataFrame([(1, name, "Norvane", None, None, None, "s1", T0 + DAY, None), (2, name, "NORVANE", None, None, None, "s2", T0, "Bath")], LISTING + ", source string, crawl_timestamp timestamp, category string")
    sources = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, trust_rank int")
    by = lambda *policy: {r.field_name: r.field_value for r in clear_fields(clusters, listings, sources, policy=policy).collect()}
    assert by("trust", "recency", "completeness") == {"brand": "Norvane", "category": "Bath", "name": f"Norvane {name}"}
    assert by("completeness", "trust", "recency") == {"brand": "NORVANE", "category": "Bath", "name": f"Norvane {name}"}


def test_names():
    members = ["Norvane Taihostibra Hand Wash Rose 500 ml Pack of 2"]
    good = "Norvane Taihostibra Hand Wash Rose 0.5 ltr (Set of 2)"
    ask = lambda name, **k: all(shown_parts(name, None, members, "norvane", "ml", 500.0, k.get("pack", 2)))
    assert ask(good) and ask("TOP RATED* " + good.upper())
    assert not ask(good.replace("Norvane", "Kelvane"))
    assert not ask(good.replace("0.5", "0.6"))
    assert not ask(good.replace("Set of 2", "Set of 3")) and not ask(good, pack=1)
    assert not ask("Norvane Taihostibra Hand W") and not ask(None) and not ask(" ") and not ask("N/A")
    assert cut_off("Norvane Taiho…", []) and cut_off("Norvane Hand-", []) and cut_off("Norvane (Set", []) and not cut_off("Norvane Rose", ["Rose"])
    assert not cut_off("Norvane Taihostibra Hand Wash Rose 500 g", ["Norvane Taihostibra Hand Wash Rose 500 gms"])
    assert cut_off("Norvane Taihostibra Salted", ["Taihostibra Salted Butter Classic"]) and cut_off("Norvane Taihostibra Hand Wash", ["Taihostibra Hand Wash Rose"])


def test_clear_fields(spark):
    clusters = spark.createDataFrame([(1, [1, 2, None], ["a", "b"], "Norvane Taihostibra Hand Wash Rose 500 ml", "Here is the name:"), (1, [1, 2, None], ["a", "b"], "Norvane Taihostibra Hand Wash Rose 500 ml", "Here is the name:"), (2, [], [], None, None), (None, [1], ["a"], "x", "y")], "cluster_id bigint, member_ids array<bigint>, members array<string>, medoid_name string, llm_name string")
    listings = spark.createDataFrame([(1, "Norvane Taihostibra Hand Wash Rose 500 ml", "Norvane", None, None, None, "s1", T0 + DAY, "Bath"), (2, "Taihostibra Hand Wash Rose 500 ml", "NORVANE", None, None, None, "s2", T0, "Bath")], LISTING + ", source string, crawl_timestamp timestamp, category string")
    sources = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, trust_rank int")
    got = rows(clear_fields(clusters, listings, sources))
    assert got == [(1, "brand", "Norvane"), (1, "name", "Norvane Taihostibra Hand Wash Rose 500 ml")]
    assert rows(clear_fields(clusters.where("false"), listings, sources)) == []
    assert rows(clear_fields(clusters, listings.where("false"), sources)) == []
