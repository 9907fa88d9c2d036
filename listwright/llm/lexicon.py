"""Fixed values for reading product attributes: kinds of article, variants and promotional phrases, with their synonyms.

One line is one meaning; phrases of a line are separated by semicolons, the first names it. Words may stand in any order.
"""

# Kinds of article.
KINDS = """
ashwagandha capsules; ashwagandha caps
basmati rice; basmati chawal; बासमती चावल
bath soap; soap bar; sabun; soap; साबुन
bedsheet; bed sheet cover; bed sheet; chadar
black tea; tea leaf; chai patti; चाय
body wash; shower gel
coconut water; nariyal pani
cola drink; soft drink cola; cola
digestive biscuits; digestives
dog food; pet food dog; dry dog meal
extension cord; extension board; power strip
fabric conditioner; fabric softener
floor cleaner; surface cleaner
fruit juice; jus de fruits; juice; сок
fry pan; frying pan; tawa pan
ground coffee; filter coffee; coffee powder; coffee
gruyere slices; sliced gruyere; gruyere
hand wash; liquid handwash; handwash
hand-held bag; ladies handbag; handbag; tote
instant noodles; cup noodles; noodles
kadhai; kadai; deep wok
laptop sleeve; notebook sleeve; laptop cover
led monitor; monitor; display screen
muesli
mustard oil; sarson tel; सरसों तेल
paneer; cottage cheese
peanut butter; groundnut spread
pencil box; pencil case
potato chips; aloo chips; crisps potato; crisps
rolled oats; oats
rose water; gulab jal; ροδόνερο
round neck t-shirt; round neck tshirt; crew tee
salted butter; table butter; makkhan
shampoo; hair cleanser
showpiece; decor piece; figurine
storage jar; kitchen jar; canister
sunflower oil; refined sunflower oil
swimming goggles; swim goggles
table salt; iodised salt; namak; salt; नमक
talcum powder; talc
toor dal; arhar dal; tur dal
toothpaste; dental cream
turmeric powder; haldi powder; haldi; हल्दी
vitamin tablets; vitamin tabs; daily vitamins; daily vitamin
wall clock; clock for wall
washing powder; detergent powder
wheat flour; atta flour; chakki atta; atta; आटा
wireless router; wifi router; router
"""

# Flavours, scents, colours, grades and editions.
VARIANTS = """
acai berry
aloe vera; aloevera
beige
black
broken
cafe scrub
charcoal
chocolate; choco
citrus
classic
coconut; nariyal
creme
creme vanilla
everyday; daily
gold
graphite
grey; gray
honey
jalapeno
jeera
jumbo
kids
lavender
lemon; nimbu
lite
low salt; less salt
mango puree
maroon
masala
men
mint; pudina
navy blue
neem
olive
organic; org
peri peri
plain
premium; prem
red
rose
saffron; kesar
salted
sandal
senor edition
sharbati
silver
sona
strawberry; strawb
teal
unpolished
white
women
ताज़ा
"""

# Promotional phrases, as they are printed.
PROMOTIONS = """
100% genuine; 24x7 fresh; assured; b1g1; best price; buy now; free delivery; hot deal!; imported quality; limited offer
must have; new arrival; no.1 choice; original; special offer!!; super saver; top rated*; #trending
"""

# Variants that merely praise where another variant is named.
ALSO_PRAISE = ["premium"]

# Words that join the parts of a name.
JOINERS = "by of x and & pack set combo box case pk pc pcs piece pieces nos model edition half"

# Recorded values that stand for no value.
FILLERS = ["", "-", "--", "---", "?", "n/a", "na", "n.a.", "nan", "none", "null", "nil", "unknown", "not available", "not known", "unbranded", "tbd"]
