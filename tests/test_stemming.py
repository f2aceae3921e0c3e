"""The examples of the published description of the stemmer, step by step, as the whole cascade leaves them, and some of its sample vocabulary."""

from pyspark.sql import functions as F

from factloom.functions.stemming import porter

# Words and their published stems.
STEMS = """caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|
happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|hesitanci hesit|digitizer digit|conformabli conform|radicalli radic|differentli differ|vileli vile|analogousli analog|vietnamization vietnam|predication predic|operator oper|feudalism feudal|
decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|
gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|
probate probat|rate rate|cease ceas|controll control|roll roll|generalizations gener|oscillators oscil|knightly knightli|knocking knock|consign consign|consigned consign|consolation consol|consolingly consolingli|knees knee|knell knell|abatements abat|absolutely absolut|
university univers|yes ye|youth youth|sayings sai|analogy analog|is is|a a|by by"""


def test_published_examples(spark):
    pairs = [x.strip().split(" ") for x in STEMS.replace("\n", "").split("|")]
    rows = spark.createDataFrame([(a, b) for a, b in pairs], "word string, stem string").withColumn("got", porter(F.col("word")))
    assert [(r.word, r.got) for r in rows.collect() if r.got != r.stem] == []


def test_other_words(spark):
    rows = spark.createDataFrame([("",), (None,), ("Été",), ("RUNNING",), ("naïvely",), ("x" * 100_000,)], "w string").select(porter(F.col("w")).alias("s"))
    got = [r.s for r in rows.collect()]
    assert got[0] == "" and got[1] is None and got[2] == "été" and got[3] == "run" and got[5] == "x" * 100_000
