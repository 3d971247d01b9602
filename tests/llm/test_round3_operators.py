"""Hard negatives, conversation repair and licence scan against brute-force versions, and their edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortry.llm import conversation_repair, hard_negatives, licenses
from cohortry.llm.shared import stored
from tests.conftest import SMALL

CLASH = ("row", "score", "kind", "block", "place", "mark", "copy", "labels", "rank", "q")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("big", [1, 100, 3_000_000])
def test_residue_product_is_exact(big):
    rng = np.random.default_rng(big)
    for width in (0, 1, 64, 3000):
        a, b = rng.integers(-big, big + 1, (7, width)), rng.integers(-big, big + 1, (5, width))
        bound = int(max((a.astype(object) ** 2).sum(axis=1).max(initial=0), (b.astype(object) ** 2).sum(axis=1).max(initial=0)))
        primes = hard_negatives.primes_for(bound)
        got = hard_negatives.product(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert (got == a.astype(object) @ b.astype(object).T).all() if width else not got.any()


def brute_negatives(rows, positives=5, negatives=3):
    whole = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((vec_id, label, [int(np.floor(256.0 * x)) for x in v]))
    out = Counter()
    for n, (anchor, label, v) in enumerate(whole):
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), other, own) for m, (other, own, w) in enumerate(whole) if m != n)
        for s, positive, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(x, i) for x, i, own in scored if own != label and 50 * -s <= 100 * -x <= 95 * -s][:negatives]
            for rank, (x, i) in enumerate(fits, 1):
                out[anchor, positive, rank, i, -s, -x] += 1
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.gauss(0.1, 0.3) for _ in range(rng.choice((6, 6, 6, 4)))]) for i in range(400)]
    hot = [0.25, 0.5, -0.125, 0.0, 0.25, 0.5]
    rows += [(400 + i, i % 3, hot) for i in range(300)]  # one vector shared by many rows
    rows += [(50, 1, hot), (50, 1, hot), (101, 2, hot), (101, 2, hot)]  # repeated rows
    rows += [(None, 1, hot), (1000, None, hot), (1050, 1, None), (1100, 1, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (1150, 2, [float("nan")] * 6), (1200, 2, [float("inf")] * 6),
             (1250, 2, []), (1300, 0, [1e30] * 6), (1350, 3, [2.0 ** 20] * 6), (1351, 2, [2.0 ** 20] * 5 + [2.0 ** 19])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return rows, stored(df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(5), "vectors")


def mined(df, **more):
    whole = hard_negatives.whole_vectors(df, F.col("vec_id"), F.col("label"), F.col("embedding"))
    return hard_negatives.mine(whole, F.col("vec_id") % 50 == 0, **more)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_negatives_match_brute_force(vectors, block_bytes):
    rows, df = vectors
    want = brute_negatives([r for r in rows if r[0] != 1300])  # its products need not fit a long
    assert want and rows_of(mined(df, block_bytes=block_bytes)) == want


def test_negatives_of_nothing(vectors):
    assert mined(vectors[1].limit(0)).collect() == []
    assert mined(vectors[1].filter("vec_id % 50 <> 0")).collect() == []


def fits(initials):
    """(s?(ua)+)?"""
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) >= 2 and rest == "ua" * (len(rest) // 2))


def brute_repair(rows, costs, most=2):
    """Cheapest, then least audit of rows (role, text), by trying everything; the repaired rows."""
    seen, kinds = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    spots = len(rows) + 1
    for put in itertools.product(range(most + 1), repeat=spots):
        if sum(put) > most:
            continue
        choices = []
        for i in range(spots):
            choices += [[("I", "user", ""), ("I", "assistant", "")]] * put[i]
            if i < len(rows):
                role, text = rows[i]
                some = [("D", None, None)]
                if kinds[i] not in ("blank", "duplicate"):
                    some += [("K", role, text), ("R", "user", text), ("R", "assistant", text)]
                choices.append([(*c, kinds[i]) for c in some])
        for way in itertools.product(*choices):
            left = [w for w in way if w[0] != "D"]
            if not fits("".join(w[1][:1] or "?" for w in left)):
                continue
            cost = sum({"K": 0, "R": costs.rename, "D": costs.delete, "I": costs.insert}[w[0]] + (costs.truncated if len(w) > 3 and w[0] != "D" and w[3] == "truncated" else 0) for w in way)
            found = cost, "".join(w[0] for w in way), [w[1:3] for w in left]
            if best is None or found[:2] < best[:2]:
                best = found
    return best, Counter(kinds)


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, 5)):
            text = rng.choice(("Yes.", "No!", "why", " ", "", "ok.", "More?", "a b"))
            rows.append((conv, rng.choice((turn, turn + 1, None)), rng.choice(("user", "assistant", "system", "tool", "", None)), rng.choice((text, text, text, None))))
    return rows


def ordered(rows):
    """(turn, role, text) of a conversation in the defined order."""
    def key(r):
        role, text = (" " if x is None else x for x in r[1:])
        return r[0] is not None, r[0] or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return [(t, " " if r is None else r, " " if x is None else x) for t, r, x in sorted(rows, key=key)]


@pytest.mark.parametrize("costs, bits", [(conversation_repair.Costs(), 12), (conversation_repair.Costs(), 1), (conversation_repair.Costs(rename=2, delete=4, insert=1, truncated=1), 1),
                                         (conversation_repair.Costs(rename=1, delete=1, insert=1, truncated=1), 0)])
def test_repair_matches_brute_force(spark, monkeypatch, costs, bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    rows = conversations(random.Random(bits + costs.insert), 60)
    named = [(None if c == 7 else c, *r) for c, *r in rows]
    df = stored(spark.createDataFrame(named, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3), "turns")
    empty = spark.createDataFrame([(900,), (900,)], "conv_id long")
    got = {r["conv_id"]: r.asDict() for r in conversation_repair.repair(df, df.select("conv_id").union(empty), costs).collect()}
    assert set(got) == {r[0] for r in named} | {900}
    assert got[900] == {"conv_id": 900, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    for conv in {r[0] for r in named}:
        own = ordered([r[1:] for r in named if r[0] == conv])
        (cost, audit, kept), kinds = brute_repair([r[1:] for r in own], costs)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        have = got[conv]
        assert (have["cost"], have["audit"]) == (cost, audit), own
        assert have["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        assert [have[k] for k in ("blank", "duplicate", "truncated")] == [kinds[k] for k in ("blank", "duplicate", "truncated")]
        assert have["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert have["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def test_long_conversation_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("Yes.", "why")) if rng.random() < 0.1 else f"{i}.") for i in range(3000)]
    df = stored(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), "turns")
    results = []
    for bits in (12, 5):
        monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
        results.append(conversation_repair.repair(df, df).collect())
    assert results[0] == results[1] and len(results[0][0]["audit"]) >= 3000


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "assistant", "Hello. You? Yes!") for c in range(40) for t in range(5)] + [(None, 1, None, None), (3, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: (text or " ").translate(str.maketrans("", "", ".!?"))}.get(kind, text or " ")
        want[c, t, "user" if kind == 4 else role or " ", text] += (kind != 0) + (kind == 3)
    assert rows_of(conversation_repair.damaged(df)) == +want
    assert conversation_repair.repair(df.limit(0), df.limit(0)).collect() == []


def test_audits_compare_as_texts():
    rng = random.Random(1)
    trail, texts = conversation_repair.Trail(), {}
    for _ in range(400):
        text = "".join(rng.choice("DIKR") for _ in range(rng.randrange(12)))
        node = 0
        for letter in text:
            node = trail.push(node, letter)
        assert texts.setdefault(text, node) == node and trail.text(node) == text
    some = rng.sample(sorted(texts), 60)
    assert all(trail.less(texts[a], texts[b]) == (a < b) for a in some for b in some)
    trail.hash = [0] * len(trail.hash)  # every hash collides: the nodes decide
    assert all(trail.less(texts[a], texts[b]) == (a < b) for a in some for b in some)


def brute_licenses(index, text):
    """Every place of every phrase, and of every template by its definition."""
    words = licenses.words_of(text)
    base = [(i, label) for phrase, label in index.phrases for i in range(len(words)) if tuple(words[i:i + len(phrase)]) == phrase]
    found = []
    for t in index.templates:
        shared = sorted(set(t.words) & set(words), key=lambda w: (-index.weight[w], w))[:licenses.RARE]
        need, slack = min(licenses.AGREE, len(shared)), licenses.SLACK
        for start in range(-len(t.words), len(words)):
            near = words[max(0, start - slack):start + len(t.words) + 2 * slack]
            if not need or not all(any(tuple(near[i:i + len(k)]) == k for i in range(len(near))) for k in t.keys):
                continue
            aligned = {w for i, w in enumerate(t.words) if w in shared and w in words[max(0, start + i):max(0, start + i + slack + 1)]}
            weight = sum(index.weight[w] for w in t.words)
            share = sum(index.weight[w] for i, w in enumerate(t.words) if w in words[max(0, start + i - slack):max(0, start + i + 2 * slack + 1)]) / weight
            if len(aligned) >= need and share >= licenses.LEAST:
                found.append((t.label, share))
    own = {label for _, label in base}
    return len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted(own)), ",".join(sorted(own | {a for a, _ in found}))


def test_licences_match_brute_force(spark):
    rng = random.Random(2)
    plain = [w.decode() for w in licenses.Index().vocabulary] + ["foo", "bar", "été", "Baz-7"]
    rows = [(None, "All Rights\nreserved, all rights reserved"), (1, None), (2, ""), (3, "cc by cc by-nc 4.0"), (3, "cc by cc by-nc 4.0"), (4, "x " * 50_000 + "MIT License released under the MIT License")]
    for i in range(10, 260):
        _, text, _ = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words))
            words[at:at + rng.randrange(2)] = [rng.choice(plain)] * rng.randrange(2)
        around = [" ".join(rng.choice(plain) for _ in range(rng.randrange(30))) for _ in range(2)]
        rows.append((i, f"{around[0]} {' '.join(words).upper() if i % 3 else ' '.join(words)} {around[1]}" if i % 5 else around[0]))
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3), "texts")
    index = licenses.Index()
    present = Counter(w for _, text in rows for w in set(licenses.words_of(text)))
    index.weigh(len(rows), present)
    got = licenses.scan(df).collect()
    want = Counter((i, *brute_licenses(index, text)) for i, text in rows)
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in got)
    assert len({r["labels"] for r in got}) > 8
    assert licenses.scan(df.limit(0)).collect() == []


def test_licences_of_the_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    index = licenses.Index()
    index.weigh(len(docs), Counter(w for text in docs.values() for w in set(licenses.words_of(text))))
    for r in entry.queries()["op13_scan_licenses"](spark, SMALL).collect():
        assert tuple(r)[1:7] == brute_licenses(index, docs[r["doc_id"]])
