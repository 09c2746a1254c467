import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lexmill.llm import split_overlap


def corpus(seed):
    """Texts put together from recurring phrases, with near copies at every distance."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    phrases = [" ".join(r.choice(words) for _ in range(r.randint(6, 14))) for _ in range(60)]
    texts = [[r.choice(phrases) if r.random() < 0.5 else " ".join(r.choice(words) + str(r.randint(1, 99)) for _ in range(9)) for _ in range(14)] for _ in range(40)]
    for i in range(40):
        copy = [s for s in texts[i] if r.random() > 0.15 * r.random()]
        tokens = " ".join(copy).split()
        for k in range(len(tokens)):
            if r.random() < 0.09 * r.random():
                tokens[k] = "changed" + str(r.randint(1, 9999))
        texts.append([" ".join(tokens)])
    return {f"D{i:03d}": ". ".join(t) for i, t in enumerate(texts)}


def brute(texts, splits, threshold):
    """The definition: cosine over terms of five words, weighed by the classes that have them; a term
    that one split only has weighs as a term of one class."""
    terms = {}
    for k, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        terms[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    classes = defaultdict(list)
    for k in splits:
        classes[frozenset(terms[k])].append(k)
    df, sides = defaultdict(int), defaultdict(set)
    for c, members in classes.items():
        for x in c:
            df[x] += 1
            sides[x] |= {splits[m] == "train" for m in members}
    n = len(classes)
    w = lambda x: math.log(1 + n / df[x]) if len(sides[x]) > 1 else math.log(1 + n)
    norm = {k: math.sqrt(sum(w(x) ** 2 for x in terms[k])) for k in splits}
    out = {}
    for a in splits:
        for b in splits:
            if splits[a] == "train" != splits[b]:
                out[a, b] = sum(w(x) ** 2 for x in terms[a] & terms[b]) / norm[a] / norm[b]
    return {tuple(sorted(p)) for p, s in out.items() if s >= threshold}, out


def test_overlaps_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        splits = {k: ("train" if int(k[1:]) < 40 else ("dev", "test")[int(k[1:]) % 2]) for k in texts}
        base = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
        golden = spark.createDataFrame(list(splits.items()), "doc_id string, split string")
        for threshold in (0.5, 0.7):
            want, scores = brute(texts, splits, threshold)
            assert not [s for s in scores.values() if abs(s - threshold) < 1e-7]
            got = {tuple(r) for r in split_overlap.overlaps(golden, base, threshold).collect()}
            assert got == want and len(want) > 15


def test_terms_undo_typesetting(spark):
    rows = [("The ﬁrst 12,345 cases – “done”",), ("the first 12345 CASES done",), ("the fi­rst 12 345 cases (done)",)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "t string").select(split_overlap.terms_of(F.col("t"))).collect()]
    assert len(set(got)) == 1
