"""Contents against a plain reading, line by line."""

import random
import re

from tessera.operators import contents as ct


def clean(t):
    return re.sub(r"\s+", " ", t.replace("﴿", " ").replace("﴾", " ")).strip(" -.:")


def plain(lines):
    titles, expected, waiting = {}, 1, None
    for line in lines:
        if line is None or "فهرس" in line or line.strip() in ("المسألة الصفحة", "الصفحة المسألة"):
            continue
        text = re.sub(r"\.{3,}", " ", line)
        met = next((m for m in re.finditer(r"(\d{1,3})\(", text) if str(expected).endswith(m[1])), None)
        if met:
            if waiting:
                titles[waiting[0]] = clean(waiting[1])
            bare = text.replace(met[0], " ")
            name = re.sub(r"-?\)\s*:?|^\s*[-:]\s*", " ", re.sub(r"^\s*\d{1,4}\s+|\s+\d{1,4}\s*$", " ", bare))
            waiting, expected = (expected, name), expected + 1
            if re.search(r"(^|\s)\d{1,4}(\s|$)", bare):
                titles[waiting[0]], waiting = clean(name), None
        elif waiting:
            titles[waiting[0]], waiting = clean(waiting[1] + " " + re.sub(r"(^|\s)\d{1,4}(\s|$)", " ", text)), None
    return titles


def test_contents(spark):
    rng = random.Random(1)
    rows = []
    for book in range(30):
        n = 1
        for pos in range(rng.randrange(60)):
            kind = rng.randrange(9)
            words = " ".join(rng.choice(["title", "of", "a", "قول", "﴿x﴾", "-", "part:", "12x"]) for _ in range(rng.randrange(5)))
            number = str(n) if rng.random() < 0.7 else str(n)[-1]
            line = [f"{number}( {words} ........ {rng.randrange(400)}", f"{rng.randrange(400)} ..... {words} -{number}(", f"{number}(-): {words}", f"{words} {rng.randrange(999)}", words, f"{rng.randrange(50)}( {words}", "فهرس المحتويات", " المسألة الصفحة", None][kind]
            n += kind < 3
            rows.append((book, pos, line, "x"))
    got: dict = {}
    for r in ct.contents(spark.createDataFrame(rows, "book int, pos int, text string, key string").repartition(5)).collect():
        assert r["number"] not in got.setdefault(r["book"], {})
        got[r["book"]][r["number"]] = r["title"]
    want = {b: t for b in range(30) if (t := plain([x[2] for x in rows if x[0] == b]))}
    assert got == want and sum(map(len, want.values())) > 150
    assert ct.contents(spark.createDataFrame([], "book int, pos int, text string")).count() == 0
