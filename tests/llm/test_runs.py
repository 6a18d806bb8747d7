"""Periodic runs against the definition, checked for every lag of every text."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import periodic_runs
from tests.llm import brute


def plain_runs(seq):
    """(start, length, period) of all maximal stretches whose smallest period is ``period``."""
    n, out = len(seq), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                part = seq[i : i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, found):
    h, n = zlib.crc32(str(doc_id).encode()), len(found)
    if doc_id is None or h % 10 or not n:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    found = planted(doc_id, brute.WORD.findall(text or ""))
    rows = plain_runs(found)
    best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rows else None
    gone = {i for s, n, q in rows for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(rows), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in rows)), sha(" ".join(w for i, w in enumerate(found) if i not in gone)))


def periodic(rng, letters):
    """Words with runs inside runs, broken copies and stretches just too short."""
    out = []
    while len(out) < 260:
        base = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 23, 33, 40]))]
        if rng.random() < 0.3:
            base = base * rng.randint(2, 4) + [rng.choice(letters)]
        size = rng.choice([23, 24, 25, 3 * len(base) - 1, 3 * len(base), 4 * len(base) + rng.randint(0, 5)])
        out += (base * (size // len(base) + 1))[:size] + [rng.choice(letters) for _ in range(rng.randint(0, 3))]
    return out


def test_runs_are_those_of_the_definition():
    rng = random.Random(7)
    texts = [periodic(rng, letters) for letters in (["a", "b"], ["a", "b", "c"], list("abcdefghij"), [f"w{k}" for k in range(500)]) for _ in range(25)]
    texts += [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 400, ["a", "b"] * 100 + ["a"], [rng.choice("ab") for _ in range(400)]]
    # every gram of 16 words occurs twice within the period, so lags shorter than it repeat too
    x, y = ([f"{c}{k}" for k in range(20)] for c in "xy")
    texts.append([w for _ in range(4) for c in "xxxyxyyy" for w in {"x": x, "y": y}[c]])
    codes = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    counts = np.array(list(map(len, texts)))
    got = periodic_runs.find_runs(np.array([codes[w] for t in texts for w in t]), counts)
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]
    assert len(got) > 200 and len(set(got[:, 3].tolist())) > 20


def test_work_is_bounded_where_all_repeats():
    # a word over and over, and a line between words of their own: pairs would be the square
    texts = [["w"] * 200_000, [w for k in range(10_000) for w in ([f"l{x}" for x in range(18)] + [f"u{k}"])]]
    codes = np.unique(np.concatenate([np.array(t) for t in texts]), return_inverse=True)[1]
    counts = np.array(list(map(len, texts)))
    sizes = []
    for k, at, gram in periodic_runs.repeated_grams(codes + np.repeat([0, 10**6], counts), np.repeat(np.cumsum(counts), counts), int(counts.max())):
        sizes.append(len(periodic_runs.seeds(k, at, gram)[0]))
    assert max(sizes) <= counts.sum() and len(sizes) < 20
    assert periodic_runs.find_runs(codes, counts).tolist() == [[0, 0, 200_000, 1]]


@pytest.fixture(scope="module")
def periodic_rows(odd_rows):
    rng = random.Random(11)
    tens = [k for k in range(1000, 3000) if zlib.crc32(str(k).encode()) % 10 == 0][:30]
    rows = [(k, " ".join(periodic(rng, list("abc"))) if k % 2 else " ".join(f"w{x}" for x in range(k % 97))) for k in tens]
    rows += [(3000 + k, "\t".join(periodic(rng, [f"w{x}" for x in range(50)])) + "\n") for k in range(20)]
    return rows + [(i, t) for i, t, _ in odd_rows if i != 8] + [(tens[0], None), (tens[1], "")]


def test_digest_is_that_of_the_definition(spark, periodic_rows):
    df = spark.createDataFrame(periodic_rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as length", "'x' as period")
    got = Counter(tuple(r) for r in periodic_runs.digest(df).collect())
    assert got == Counter(plain_digest(*r) for r in periodic_rows)
    assert periodic_runs.digest(df.where("false")).count() == 0


def test_runs_and_collapsed_texts(spark, odd_documents, odd_rows, no_documents):
    want = Counter((i, *r) for i, t, _ in odd_rows if i != 8 for r in plain_runs(brute.WORD.findall(t or "")))
    assert want and Counter(tuple(r) for r in periodic_runs.runs(odd_documents.where("doc_id <> 8 or doc_id is null")).collect()) == want
    out = periodic_runs.collapsed(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == len(odd_rows)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[13].text == "w" and texts[13].n_chars == 1 and texts[14].text == "LOUD WORDS"
    assert all(texts[i].text == t for i, t, _ in odd_rows if i in (1, 3, 5, 6, 7, 8, 10, 12))
    assert periodic_runs.collapsed(no_documents).count() == 0 and periodic_runs.runs(no_documents).count() == 0
