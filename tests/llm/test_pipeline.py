import random

import corpus_pipeline as pipeline
from tessera.llm.packing import default_tokenizer, tokenizer_of
from tests.llm.test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _run(spark, tmp_path, rows):
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        seen.append(docs)
    return path, seen


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    clean = [(i, prose(rng, 120), "en", f"s{i % 3}", 1) for i in range(60)]
    near = clean[5][1].split()
    near[60] = "edited"
    more = [(100, clean[3][1], "en", "s0", 1), (101, clean[3][1] + " \n", "en", "s1", 1), (102, " ".join(near), "en", "s0", 1), (103, None, "en", "s0", 1), (104, "", None, None, 0), (105, "123 ??", "en", "s1", 1), clean[7], (None, prose(rng, 30), None, None, None)]
    path, seen = _run(spark, tmp_path, clean + more)
    ids = [sorted((r[0] for r in s.select("doc_id").collect()), key=repr) for s in seen[:4]]
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in seen[:4])
    assert not {103, 104, 105} & set(ids[0]) and len(ids[0]) == 65
    assert set(ids[1]) == (set(range(60)) - {3}) | {101, 102, None} and len(ids[1]) == 62
    assert set(ids[2]) == set(ids[1]) - {102}
    assert set(ids[3]) <= set(ids[2])
    ids_of = tokenizer_of(default_tokenizer())
    want = sorted(i for r in seen[3].collect() for i in ids_of(r["text"]).tolist())
    assert sorted(i for r in seen[4].collect() for i in r["ids"]) == want
    assert pipeline.run(spark, path).count() == seen[4].count()


def test_no_documents(spark, tmp_path):
    assert _run(spark, tmp_path, [])[1][-1].count() == 0


def test_clashing_names_maps_and_repeated_rows(spark):
    """Columns of any name and kind go through the stages that keep rows."""
    rng = random.Random(2)
    schema = SCHEMA + ", row int, id string, row_key string, copies int, __key int, found map<string,int>"
    rows = [(i, prose(rng, 40), "en", "s", 1, i, "x", None, 2, 3, {"a": i}) for i in range(8)]
    rows += [rows[0], (1, rows[1][1], "en", "s", 1, 7, "y", "z", 1, 1, {"b": 1})]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert {r["row"] for r in docs.select("row").collect()} <= set(range(8)) and docs.where("found is null").isEmpty()


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(0, "some words here", None, "s", 1), (1, "12 34", None, "s", 1), (2, None, None, None, None)]
    kept = pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_run_against_plain_stages(spark, tmp_path):
    """What each stage keeps, by brute force over all rows and pairs."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = prose(rng, rng.randrange(20, 90)).split()
        rows.append((len(rows), " ".join(words), "en" if i % 2 else "de", f"s{i % 3}", 1))
        for _ in range(rng.randrange(3)):
            own = [w if rng.random() > 0.04 else f"new{rng.randrange(999)}" for w in words]
            rows.append((len(rows), rng.choice([" ", "  \n"]).join(own), "en" if i % 2 else "de", f"s{i % 3}", 1))
    rows += [(len(rows) + k, t, "en", "s0", 1) for k, t in enumerate(["", "123 456", "!"])]
    path, seen = _run(spark, tmp_path, rows)
    text = {r[0]: r[1] for r in rows}
    left = [i for i, t in text.items() if any(c.isalpha() for c in t)]
    assert sorted(r["doc_id"] for r in seen[0].collect()) == left
    by: dict = {}
    for i in left:
        by.setdefault("".join(text[i].split()), []).append(i)
    left = sorted(min(own, key=lambda i: (-len(text[i]), i)) for own in by.values())
    assert sorted(r["doc_id"] for r in seen[1].collect()) == left

    def alike(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
        return row[-1] >= 0.8 * max(len(a), len(b))

    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(left):
        for j in left[:k]:
            if alike(text[i].split(), text[j].split()):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = sorted({find(i) for i in left})
    assert sorted(r["doc_id"] for r in seen[2].collect()) == left
    taken = [r["doc_id"] for r in seen[3].collect()]
    assert set(taken) <= set(left) and max(taken.count(i) for i in left) <= 3
    ids_of = tokenizer_of(default_tokenizer())
    assert sorted(i for r in seen[4].collect() for i in r["ids"]) == sorted(x for i in taken for x in ids_of(text[i]).tolist())
