"""The Merkle manifest, decontamination and the filter audit against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from assayworks.llm import decontaminate, filter_audit, merkle
from assayworks.llm.common import lower_ascii


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves: list[str], arity: int = 8):
    """Root and, per leaf, the siblings level by level as (before, after)."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // arity * arity:place // arity * arity + arity]
            proofs[i].append((run[:place % arity], run[place % arity + 1:]))
        level = [h(*level[i:i + arity]) for i in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0], proofs


def manifest_of(rows, arity=8):
    def digest(doc, source, lang, n, text):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])

    def small(text):
        return text if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)

    order = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((order(r[0]), digest(*r), r))
    heads, inner = [], {}
    for lang in sorted(groups, key=order):
        mine = sorted(groups[lang], key=lambda x: x[:2])
        head, proofs = tree([x[1] for x in mine], arity)
        inner[lang] = mine, head, proofs
        heads.append(head)
    root, top = tree(heads, arity) if heads else (None, [])
    out = []
    for (lang, (mine, head, proofs)), above in zip(inner.items(), top, strict=True):
        for (_, leaf, r), proof in zip(mine, proofs, strict=True):
            whole = proof + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = digest(*r[:4], small(r[4])) if changed else leaf
            for a, b in whole:
                fold = h(*a, fold, *b)
            out.append((r[0], leaf, head, root, h(*[x for a, b in whole for x in (*a, *b)]), fold, fold == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def found_manifest(spark, rows, arity=8):
    def tampered(field):
        own = F.col(field)
        return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower_ascii(own)).otherwise(own) if field == "text" else own

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for clash in ("leaf", "place", "n", "tree", "tie", "members"):
        df = df.withColumn(clash, F.lit("x"))
    found = merkle.manifest(df, tampered, arity).withColumn("proof", F.sha2(F.lower(F.hex("proof")), 256))
    return sorted(map(tuple, found.collect()), key=repr)


def some_documents(n, langs, rng):
    rows = [(rng.randrange(n * 2), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 3]), rng.choice(["Ab É", "x", "", None, "QQ" * i])) for i in range(n)]
    return rows + rows[:n // 5] + [(None, None, None, None, None), (None, "s", langs[0], 1, "Z" * 200_000)]


@pytest.mark.parametrize("n, langs, arity", [(1, ["en"], 8), (40, ["en", None, "é", "", "z"], 8), (300, ["en", "fr"], 8), (60, [f"l{i}" for i in range(30)], 3)])
def test_manifest(spark, n, langs, arity):
    rows = some_documents(n, langs, random.Random(n))
    assert found_manifest(spark, rows, arity) == manifest_of(rows, arity)


def test_manifest_of_little(spark):
    assert found_manifest(spark, []) == []
    for rows in ([(7, None, "en", 1, "A")], [(3, None, "en", 1, "A")] * 9, [(1, "s", None, 0, ""), (1, "s", "a", 0, "")]):
        assert found_manifest(spark, rows) == manifest_of(rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def leaks_of(docs, items, window):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, whose = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (these := windows.get(tuple(w[i:i + n]))) is not None:
                    whose |= these
                    hit |= set(range(i + 1, i + n + 1))
        spans, last = [], None
        for p in sorted(hit):
            if last is not None and p == last + 1:
                spans[-1] = (spans[-1][0], p)
            else:
                spans.append((p, p))
            last = p
        out.append((doc, len(w), len(hit), spans, sorted(whose)))
    return sorted(out, key=repr)


def found_leaks(spark, docs, items, window, gram=5):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for clash in ("key", "words", "gram", "pos", "n_words", "window", "item"):
        d, b = d.withColumn(clash, F.lit("x")), b.withColumn(clash, F.lit("y"))
    rows = decontaminate.contamination(d, b, window, gram).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"])) for r in rows], key=repr)


@pytest.mark.parametrize("seed, window, gram", [(1, 10, 5), (2, 4, 3), (3, 3, 5), (4, 6, 1)])
def test_decontamination(spark, seed, window, gram):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice(["a", "B", "c7", "é", "ß\x85x", "the"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, text(rng.randrange(0, 16))) for i in range(12)] + [(3, "a b c"), (None, "only null"), (50, None), (51, " .,"), (52, "Unseen words here"), (10, "a b c")]
    docs = [(i, text(rng.randrange(0, 40))) for i in range(60)] + [(1, None), (2, ""), (3, items[0][1]), (3, "x " + (items[1][1] or "") + " y"), (None, "A b C")]
    docs += [(900, "the only null the " * 3_000), (901, "...")] + docs[:8]
    docs += [(2000 + i, "a b c " + items[2][1]) for i in range(200)]
    assert found_leaks(spark, docs, items, window, gram) == leaks_of(docs, items, window)


def test_decontamination_of_little(spark):
    assert found_leaks(spark, [], [(1, "a b")], 10) == []
    assert found_leaks(spark, [(1, "a b"), (2, None)], [], 10) == [(1, 2, 0, [], []), (2, 0, 0, [], [])]
    assert found_leaks(spark, [(1, "a A a")], [(7, "A"), (8, "a a"), (8, "a")], 10) == [(1, 3, 3, [(1, 3)], ["7", "8"])]


def audit_of(docs, labels):
    def fails(doc, text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [d for d, _, x in docs if (x or "") == t and d is not None]
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and any(d < doc for d in same)}

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, x in labels if x == 1 and d is not None}
    rows = [(lang or "", {f for f, no in fails(doc, text).items() if no}, doc in good, doc in bad) for doc, lang, text in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key, counts in out.items():
            if key[0] == part and len(counts) == 6:
                counts.append(total[key[1][key[2] - 1]])
    return out


def found_audit(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for clash in ("fails", "part", "key", "good", "docs", "first", "w"):
        d, marks = d.withColumn(clash, F.lit("x")), marks.withColumn(clash, F.lit("y"))
    rows = filter_audit.interaction_audit(filter_audit.failures(d), marks).collect()
    assert len(rows) == len({r[:3] for r in rows})
    return {tuple(r[:3]): list(r[3:]) for r in rows}


def test_filter_audit(spark):
    rng = random.Random(9)
    texts = [None, "", "word " * 120, "A B C", "x$", " ".join(f"w{i}" for i in range(150)), " ".join(f"W{i}" for i in range(100)), "é" * 50,
             " ".join(f"w{i} w{i}" for i in range(70)) + "&", "\x0b \t", "\x85   \x1c", "Long " * 60_000]
    docs = [(rng.randrange(60), rng.choice(["en", None, "", "de"]), rng.choice(texts)) for _ in range(120)] + [(None, "en", ""), (None, None, "x$")]
    labels = [(rng.randrange(70), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)] + [(None, 1, 1)]
    assert found_audit(spark, docs, labels) == audit_of(docs, labels)


def test_filter_audit_of_little(spark):
    assert found_audit(spark, [], []) == {}
    assert found_audit(spark, [(1, "en", None)], []) == audit_of([(1, "en", None)], [])


def test_least_squares_give_shapley_values():
    """Any game's shares, against the average over all orders."""
    rng = random.Random(0)
    for n in range(1, 6):
        weights = filter_audit.shapley_weights(n)
        game = [0] + [rng.randrange(-50, 1000) for _ in range((1 << n) - 1)]
        orders = list(permutations(range(n)))
        for i in range(n):
            gains = 0
            for order in orders:
                before = sum(1 << j for j in order[:order.index(i)])
                gains += game[before | 1 << i] - game[before]
            assert sum(w * v for w, v in zip(weights[i], game, strict=True)) == Fraction(gains, len(orders))
