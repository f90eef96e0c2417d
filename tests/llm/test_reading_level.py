import random

from strandline.llm.reading_level import reading_levels, running_text, tokens_of

DOCS = "doc_id long, text string, lang string, level string, band string"
RATINGS = "doc_id long, band int, rater string"
EASY = ["Open the page and read it.", "Click the box and wait a bit.", "Ask your team if it is old.", "Now you are done with the list.", "Lies die Notiz und dann die Liste.", "Prüfe die kleine Datei noch einmal."]
HARD = [
    "Notwithstanding the architecturally significant reconciliation, orchestration circumscribes intermediate representations.",
    "Whereas commutativity characterises theoretical underpinnings, serialisability substantiates operational ramifications.",
    "Die Unveränderlichkeit der Herkunftsinformationen rechtfertigt eine ausdifferenzierte Berechtigungskonzeption.",
    "Ungeachtet der Nachvollziehbarkeit der Zustandsübergänge bedingt die Synchronisationshierarchie eine Neubewertung.",
]


def corpus(n=400, seed=1):
    r = random.Random(seed)
    docs, bands = [], {}
    for i in range(n):
        band = r.randrange(1, 5)
        share = {1: 0.05, 2: 0.3, 3: 0.6, 4: 0.95}[band]
        docs.append((i, "# Title\n\n" + " ".join(r.choice(HARD if r.random() < share else EASY) for _ in range(20)), "en", None, None))
        bands[i] = band
    return docs, bands


def test_held_out_accuracy(spark):
    docs, bands = corpus()
    rated = [(i, bands[i], f"r{i % 3}") for i in range(0, 400, 2)]
    got = {r["doc_id"]: r for r in reading_levels(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rated, RATINGS)).collect()}
    held = [i for i in range(1, 400, 2)]
    right = sum(got[i]["band"] == bands[i] for i in held) / len(held)
    four = [i for i in held if got[i]["band"] == 4]
    assert right > 0.75
    assert sum(bands[i] == 4 for i in four) / len(four) > 0.9 and sum(bands[i] == 4 for i in four) > 0.85 * sum(bands[i] == 4 for i in held)


def test_no_level(spark):
    docs, bands = corpus(40)
    odd = [(101, None, None, None, None), (102, "  \n", None, None, None), (103, "Too short.", None, None, None), (104, "```\n" + "x = call(1)\n" * 200 + "```\nSee the code above.", None, None, None), (None, docs[0][1], None, None, None), docs[1]]
    rated = [(i, bands[i], "r") for i in range(40)] + [(None, 4, "r"), (3, None, "r"), (999, 4, "r")]
    d, r = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(rated, RATINGS)
    ids = [x["doc_id"] for x in reading_levels(d, r).collect()]
    assert sorted(ids) == list(range(40))
    assert reading_levels(d, r.limit(0)).count() == 0 and reading_levels(d.limit(0), r).count() == 0


def test_running_text():
    body, code = running_text("# Head\r\n\r\nOne line.\r\n- an item\r\n| a | b |\r\n> quote\r\n```py\r\ncode()\r\n```\r\n`x` after https://a.example/b.\r\n")
    assert [x.strip() for x in body.split("\n")] == ["one line.", "an item", "after"] and 0 < code < 0.2
    flat = "# Title here " + "and then a long text whose line ends were lost. " * 8
    assert tokens_of(flat, {}) is not None
