import pytest

from seekspark.llm import abuse

FOUND = [
    "You are a complete moron, go back to school.", "you 1d10t!", "Only a s.c.u.m.b.a.g like you would do that.", "what an i***t you are", "Tu es un vrai c o n n a r d.", "You are an іdіоt.", "you are a bas\u200btard", "you mooooron",
    "Women are vermin and should be kept out.", "Send all immigrants back, they ruin everything.", "Ausl\xe4nder sind Dreck.", "Los inmigrantes son una plaga.", "I will find out where you live", "GO KILL YOURSELF", "Ich wei\xdf, wo du wohnst.",
    "Hot singles want to fuck tonight", "send me nudes instead", "Du bist ein Vollidiot &#33;", "Je sais o\xc3\xb9 tu habites",
]
CLEAN = [
    "I was stupid, I forgot the flag.", "The rules forbid calling people idiot or moron.", "The block list holds the words 'bastard', 'porn' and 'asshole'; add yours below.", "Kill the process and restart it.", "This API sucks, we hate it.",
    "Holy shit, it is fast!", "We ban hate against women, immigrants or any other group.", "Breast cancer screening data.", "Column sex is M, F or null.", "Your patch is wrong and I can not approve it.", "The cockpit is in Scunthorpe.",
    "A dumb terminal cannot show the row.", "Putain de bug, encore.", "**bold** words and x*y*z", "", "   ",
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    assert abuse.matcher().score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert abuse.matcher().score(text)[0] < abuse.THRESHOLD


def test_length_does_not_matter():
    m = abuse.matcher()
    calm = "the old ledger keeps a row in order "
    assert m.score(calm * 3000 + "you moron " + calm * 3000)[0] == m.score("you moron")[0]
    assert m.score("moron " + calm * 30 + "you")[0] < 1


def test_scores_and_rates(spark):
    rows = [(1, "you moron", "a"), (2, None, "a"), (3, "fine", "b"), (4, "you moron", None), (4, "you moron", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [(r.doc_id, r.abuse.score) for r in abuse.scored(df).orderBy("doc_id").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 1.0), (4, 1.0)]
    assert {r.source: (r.documents, r.found, r.rate) for r in abuse.rates(df).collect()} == {"a": (2, 1, 0.5), "b": (1, 0, 0.0), None: (2, 2, 1.0)}
    clash = abuse.scored(df.withColumnRenamed("source", "abuse")).where("doc_id = 1").first()
    assert clash.abuse.score == 1.0 and len(clash) == 3
    assert abuse.scored(df.limit(0)).count() == 0
