import random
import re

import duckdb

from lakeloom.llm.licences import TEMPLATES, bigrams, bounds, most_words, oracle, scan

SCHEMA = "doc_id long, text string, licence string, unit string"


def grams(unit):
    words = unit.split()
    return {(a, b) for a, b in zip(words, words[1:], strict=False)}


def runs(text, percent):
    """(unit, score, licence, name): the best run of sentences and lines of each template, overlaps to the most in common."""
    plain = re.sub(r"[.!?;:]+[ \t\r\n]", "\n", (text or "").lower())
    parts = [p.split() for p in re.sub(r"[^\w\n]+|_", " ", plain).split("\n") if p.split()]
    have = {g for w in [" ".join(sum(parts, []))] for g in grams(w)}
    found = []
    for name, licence, body in TEMPLATES:
        b = {tuple(g.split()) for g in bigrams(body)}
        if (200 - percent) * len(have & b) < percent * len(b):
            continue
        best = None
        for i in range(len(parts)):
            words = []
            for j in range(i, len(parts)):
                words = words + parts[j]
                if len(words) > most_words(body, percent):
                    break
                a = set(zip(words, words[1:], strict=False))
                if a and 200 * len(a & b) >= percent * (len(a) + len(b)):
                    row = (-2 * len(a & b) / (len(a) + len(b)), len(words), i, j, len(a & b), " ".join(words))
                    best = min(best or row, row)
        if best:
            found.append((best, licence, name))
    rank = lambda x: (-x[0][4], x[0][0], x[1], x[2])
    for x in found:
        if not any(y[1] != x[1] and y[0][2] <= x[0][3] and x[0][2] <= y[0][3] and rank(y) < rank(x) for y in found):
            yield x[0][5], x[0][0], x[1], x[2]


def brute(rows, percent=80):
    near, best, units = {}, {}, {}
    for doc, text, _, _ in rows:
        plain = re.sub(r"[^\w\n]+|_", " ", (text or "").lower())
        for unit in {" ".join(u.split()) for u in [*plain.split("\n"), *re.split(r"\n[ \n]*\n", plain), plain]}:
            a = grams(unit)
            for name, licence, body in TEMPLATES:
                b = {tuple(g.split()) for g in bigrams(body)}
                if a and 200 * len(a & b) >= percent * (len(a) + len(b)):
                    near.setdefault((doc, unit), []).append((-2 * len(a & b) / (len(a) + len(b)), licence, name))
        for unit, score, licence, name in runs(text, percent):
            near.setdefault((doc, unit), []).append((score, licence, name))
    for (doc, unit), rivals in near.items():
        score, licence, name = min(rivals)
        key = (doc, licence)
        best[key] = min(best.get(key, (0, "~")), (score, name))
        units.setdefault(key, set()).add(unit)
    return {(d, lic, n, -s, len(units[d, lic])) for (d, lic), (s, n) in best.items()}


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(200):
        lines = [" ".join(rng.choice(["the", "Software", "is", "é", "licensed", "under"]) for _ in range(rng.choice([0, 1, 8, 30]))) for _ in range(rng.choice([1, 4]))]
        if rng.random() < 0.6:
            words = rng.choice(TEMPLATES)[2].split()
            for _ in range(rng.choice([0, 1, len(words) // 8])):
                words[rng.randrange(len(words))] = rng.choice(["THING", "a-b", ""])
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "\n"]) + rng.choice([" ", "  ", "\n", "\n\n", ". "]).join(words) + rng.choice(["", "\n"]))
        rows.append((i, "\n".join(lines), "x", "y"))
    return [*rows, (300, None, "", ""), (301, "", "", ""), (302, "word", "", ""), (None, "Released under the MIT License.", "", ""), (5, rows[5][1], "", ""), (303, "x y " * 50_000 + "\nReleased under the MIT License.", "", "")]


def test_against_brute_force(spark):
    got = {tuple(r) for r in scan(spark.createDataFrame(corpus(), SCHEMA)).collect()}
    assert got == brute(corpus()) and len(got) > 60


def test_oracle(spark):
    rows = corpus()
    documents = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    got = {tuple(r) for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    key = lambda r: (r[0] is None or r[0] != r[0], *r[1:])
    want = duckdb.sql(oracle()).select("doc_id, licence, template, dice, units").fetchall()
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_bounds_lose_nothing():
    for size in range(1, 60):
        low, high = bounds(size, 80)
        for n in range(1, 120):
            most = 2 * min(n, size) / (n + size)
            assert (most >= 0.8) <= (low <= n <= high)


def test_empty(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_is_native(spark):
    plan = scan(spark.createDataFrame([(1, "x", "", "")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)



def test_a_notice_has_one_licence(spark):
    rows = [(1, "This work is licensed under the GNU Lesser General Public License, version 3.", "", ""), (2, "This work is licensed under the GNU General Public License, version 3.", "", ""), (3, "licensed under the GNU Lesser General Public License, version 3.", "", "")]
    assert {(r.doc_id, r.licence) for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, "LGPL-3.0"), (2, "GPL-3.0"), (3, "LGPL-3.0")}


PROSE = "We walked along the river until it was dark and the lamps were lit."


def laid_out(text):
    """A licence as it stands in files: a paragraph after each second sentence, lines of eleven words."""
    sentences = re.split(r"(?<=[.:;]) ", " ".join(text.split()))
    paragraphs = [" ".join(sentences[i : i + 2]).split() for i in range(0, len(sentences), 2)]
    return "\n\n".join("\n".join(" ".join(p[i : i + 11]) for i in range(0, len(p), 11)) for p in paragraphs)


def test_several_paragraphs_inside_a_long_text(spark):
    long = [(i, n, lic, t) for i, (n, lic, t) in enumerate(TEMPLATES) if n.endswith(("_text", "_header"))]
    rows = [(i, f"{(PROSE + chr(10)) * 300}\n{laid_out(t)}\n\n{(PROSE + ' ') * 300}", "", "") for i, _, _, t in long]
    rows += [(100, "\n".join([PROSE] * 3000), "", ""), (101, f"{PROSE} Released under the MIT License. {PROSE}", "", "")]
    got = {(r.doc_id, r.licence): (r.template, r.dice) for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, name, licence, _ in long:
        assert got.pop((i, licence)) == (name, 1.0)
    assert got.pop((101, "MIT")) == ("mit_notice", 1.0)
    assert {lic for _, lic in got} <= {"BSD"}


def test_kin_of_overlapping_runs(spark):
    texts = {n: f"{PROSE}\n{laid_out(t)}\n{PROSE}" for n, _, t in TEMPLATES}
    rows = [(i, texts[n], "", "") for i, n in enumerate(["gpl2_header", "gpl3_header", "agpl3_header", "lgpl3_header", "bsd2_text", "bsd3_text"])]
    got = {(r.doc_id, r.licence) for r in scan(spark.createDataFrame(rows, SCHEMA)).where("licence <> 'BSD'").collect()}
    assert got == {(0, "GPL-2.0"), (1, "GPL-3.0"), (2, "AGPL-3.0"), (3, "LGPL-3.0"), (4, "BSD-2-Clause"), (5, "BSD-3-Clause")}
