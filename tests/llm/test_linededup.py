import random

from quillspark.llm import linededup as L

SCHEMA = "doc_id long, text string, removed string, row string, n_lines string"


def brute(rows, t=0.8):
    """Removed line numbers per (id, text)."""
    lines = sorted({(i, text, k) for i, text in rows if i is not None and text is not None for k in range(text.count("\n") + 1)})
    sets = [(i, text, k, frozenset(text.split("\n")[k].encode().split())) for i, text, k in lines]
    sets = [s for s in sets if s[3]]
    out = {}
    for n, (i, text, k, mine) in enumerate(sets):
        out.setdefault((i, text), [])
        if any(len(mine & other[3]) >= t * len(mine | other[3]) - 1e-9 for other in sets[:n]):
            out[i, text].append(k)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    hashed = {r["h"]: (r["doc_id"], r["text"]) for r in docs.selectExpr("struct(doc_id, xxhash64(text)) AS h", "doc_id", "text").collect()}
    return {hashed[(r["doc_id"], r["row"])]: r["removed"] for r in L.repeated_lines(docs).collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(spark, rows) == brute(rows)


def test_a_second_round_finds_what_the_tries_miss(spark, monkeypatch):
    monkeypatch.setattr(L, "TRIES", 1)
    rows = corpus(3, 40)
    assert found(spark, rows) == brute(rows)


def test_nulls_empties_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "a b c\n\na b c\nd"), (5, "c b a"), (6, "x"), (6, "x"), (None, "a b c"), (7, "long " * 20000), (8, "d\ny")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    kept = L.drop_repeated_lines(docs)
    assert kept.schema == docs.schema
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # 5 is a set equal to line 0 of 4 and goes whole; rows with one id and text are one document
    want = [(1, None), (2, ""), (3, "\n \n"), (4, "a b c\n\nd"), (6, "x"), (6, "x"), (None, "a b c"), (7, "long " * 20000), (8, "y")]
    assert got == sorted(want, key=str)
    assert L.repeated_lines(docs.limit(0)).count() == 0
    assert L.drop_repeated_lines(docs.limit(0)).count() == 0


def test_words_made_to_collide_stay_apart(spark):
    """Words whose polynomials agree modulo 2^64 (the Thue-Morse sequence and its complement) are different words."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, one), (4, one[:1024]), (5, other[:1024]), (6, one[:128]), (7, other[:128])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in L.repeated_lines(docs).collect()}
    assert got == {1: [], 2: [], 3: [0], 4: [], 5: [], 6: [], 7: []}


def test_long_lines_that_only_look_alike_do_not_travel(spark, monkeypatch):
    """A map of 64 bits says little about lines of 90 words; one of 128 bits tells most of them apart before a line is fetched."""
    rng = random.Random(5)
    rare = [f"r{k}" for k in range(100)]
    rows = [(i, " ".join([*rng.sample(rare, 20), *(f"t{rng.randrange(100)}" for _ in range(120))])) for i in range(120)]
    fetched, lines_of = [], L.lines_of
    monkeypatch.setattr(L, "lines_of", lambda wanted, *more: fetched.append(wanted.count()) or lines_of(wanted, *more))
    assert found(spark, rows) == brute(rows)
    assert sum(fetched) < 60  # with 64 bits 240
