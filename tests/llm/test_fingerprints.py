from __future__ import annotations

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import fingerprints as P


def spark_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed


def simhash(text):
    words = (text or "").lower()
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    terms = [spark_hash(*words[i : i + 2]) for i in range(len(words))]
    return sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "straße", "Übung", "çà", "in"]) + str(rng.randint(0, 60)) for _ in range(n))


def test_fingerprints_and_edits(spark, documents):  # noqa: F811
    rng = random.Random(1)
    rows = [(i * 7 % 1009, prose(rng, rng.choice([1, 2, 3, 40, 126, 127, 128, 600]))) for i in range(90)]
    rows += [(2000, "x" * 7), (2001, ""), (2002, None), (2003, "a\tb\n\nc "), (2004, prose(rng, 70_000))]
    rows.sort(key=lambda r: r[0])
    docs = documents(rows).withColumn("next", F.lit(1)).withColumn("fp", F.lit("a")).repartition(6)
    got = {r.id: r for r in P.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint % 2**64 == simhash(text) and r.edited_fingerprint % 2**64 == simhash(edited)
        assert r.next_fingerprint % 2**64 == simhash(after)


def test_repeated_and_null_ids(spark, documents):  # noqa: F811
    rows = [(None, "null id text"), (1, "one two three four"), (1, "one two three four"), (2, "b b b b"), (2, "c c c c"), (3, "last one here")]
    got = P.fingerprints(documents(rows)).collect()
    assert len(got) == len(rows)
    next_of = {None: {"one two three four"}, 1: {"b b b b", "c c c c"}, 2: {"last one here"}, 3: {"null id text"}}
    seen = {}
    for r in got:
        texts = [t for i, t in rows if i == r.id and len(t) == r.n_chars]
        options = {hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest() for t in texts for n in next_of[r.id]}
        assert r.edited_sha256 in options
        seen.setdefault(r.id, set()).add(r.next_fingerprint)
    assert all(len(v) == 1 for v in seen.values())
    alone = P.fingerprints(documents([(5, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.next_fingerprint == alone.fingerprint
    assert P.fingerprints(documents([])).count() == 0


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                base ^= 1 << b
            prints.append(base)
    prints = [P._signed(x) for x in prints]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(prints + prints[:9])], "id bigint, fingerprint bigint")
    for radius in (0, 1, 3, 5):
        got = {(r.fingerprint, r.found, r.distance) for r in P.near_fingerprints(rows, rows, radius).collect()}
        far = lambda a, b: ((a ^ b) % 2**64).bit_count()
        want = {(a, b, far(a, b)) for a in prints for b in prints if far(a, b) <= radius}
        assert got == want
    counted = P.near_counts(rows, F.col("id") % 20 == 0).collect()
    every = prints + prints[:9]
    assert len(counted) == len(every)
    for r in counted:
        want = sum(((r.fingerprint ^ x) % 2**64).bit_count() <= 3 for x in every) - 1
        assert r.n_near == (want if r.id % 20 == 0 else None)


def test_likeness_tells_edits_from_strangers(spark, documents):  # noqa: F811
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(30, 300))) for i in range(200)]
    found = P.fingerprints(documents(rows)).select(
        P.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited"),
        P.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("other"),
    )
    assert found.where("edited > other").count() >= 190
