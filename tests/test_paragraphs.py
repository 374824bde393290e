"""Paragraphs with sources on drafts written out by hand."""

from tessera.operators import paragraphs as pg


def test_paragraphs(spark):
    rows = [
        (1, "First [[Q:1:2]] and [[Q:9:9]].\n \nSecond [[H:a]] [[ Q:1:2 ]]\n\n\n[[GL:1]]\n\nThird", ["S:1", "Q:1:2", "S:2", "S:1", "S:none"]),
        (2, "One only", ["S:2", "S:1"]),
        (3, " \n\n ", ["S:1"]),
        (4, None, None),
        (5, "a\n\nb", []),
    ]
    drafts = spark.createDataFrame(rows, "doc_id int, reply string, cited array<string>")
    labels = spark.createDataFrame([("Q:1:2", "(Q 1:2)"), ("H:a", "(hadith)"), ("S:1", "s1"), ("S:2", "s2")], "id string, label string")
    near = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 3, [0.0, 1.0])], "doc_id int, place int, vector array<double>")
    items = spark.createDataFrame([(1, "S:1", [0.0, 2.0]), (1, "S:none", [1.0, 0.0])], "doc_id int, id string, vector array<double>")
    got = {r["doc_id"]: [tuple(p) for p in r["paragraphs"]] for r in pg.paragraphs(drafts, labels, near, items).collect()}
    assert got == {
        1: [("p1", "First (Q 1:2) and [⚠].", ["Q:1:2", "S:2"]), ("p2", "Second (hadith) (Q 1:2)", ["H:a", "S:1"]), ("p4", "Third", [])],
        2: [("p1", "One only", ["S:2", "S:1"])],
        5: [("p1", "a", []), ("p2", "b", [])],
    }
    assert pg.paragraphs(drafts.where("false"), labels, near, items).count() == 0
