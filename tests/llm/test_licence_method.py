"""The licence method against a plain version, and on edited licence texts that it has not seen."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb

from traceqc.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(texts, scan=licenses.Scan()):
    """[(labels of the method, score of the method)] by the words of the definition."""
    docs = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    held = Counter(x for d in docs for x in set(d))
    idf = lambda x: math.log(1 + len(docs) / (1 + held[x]))
    out = []
    for d in docs:
        labels, score, at = set(), 0.0, defaultdict(list)
        for k, x in enumerate(d):
            at[x].append(k)
        for label, text, must in licenses.TEMPLATES:
            t = text.split()
            rare = sorted(set(t), key=lambda x: (-idf(x), t.index(x)))
            weight = sum(idf(x) for x in rare[: scan.rare_words])
            mine = [x for x in rare[: scan.posted_words] if x in at][: scan.rare_words]
            votes = sorted((k - p, x) for x in mine for p, y in enumerate(t) if y == x for k in at[x])
            group = []
            for shift, x in [*votes, (math.inf, "")]:
                if group and shift - group[-1][0] > scan.slack:
                    share = sum(idf(y) for y in {y for _, y in group}) / weight
                    lo, hi = max(0, group[0][0] - scan.slack), min(len(d), group[-1][0] + len(t) + scan.slack)
                    if any(d[k : k + len(p)] == p for m in must for p in [m.split()] for k in range(lo, hi)):
                        score = max(score, min(1.0, share))
                        if share >= scan.min_share:
                            labels.add(label)
                    group = []
                group.append((shift, x))
        out.append((labels, score))
    return out


def edited(rng, text, must, share=0.06):
    """A template with some words changed, but for its mandatory phrases."""
    safe = {x for m in must for x in m.split()}
    return " ".join(x if x in safe or rng.random() > share else rng.choice(["the", "our", "work", "q"]) for x in text.split())


def documents():
    rng = random.Random(7)
    prose = [f"word{k}" for k in range(400)] + ["the", "of", "software", "use", "license", "copy", "free", "public", "version"] * 8
    some = lambda n: [rng.choice(prose) for _ in range(n)]
    texts, truth = [], []
    for k in range(240):
        words, own = some(rng.randint(20, 200)), set()
        if k % 2:
            for label, text, must in rng.sample(licenses.TEMPLATES, rng.randint(1, 2)):
                place = rng.randrange(len(words))
                line = edited(rng, text, must).capitalize().split()
                words[place:place] = ["*", *line[: len(line) // 2], "\n#", *line[len(line) // 2 :], "."]
                own.add(label)
        texts.append(" ".join(words))
        truth.append(own)
    return [*texts, None, "", "mit license", "permission is hereby granted " * 3], [*truth, set(), set(), set(), set()]


def test_equals_the_plain_version(spark):
    texts, _ = documents()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(docs.repartition(3)).collect()}
    for k, (labels, score) in enumerate(plain(texts)):
        base = set(filter(None, got[k].base_labels.split(",")))
        assert set(filter(None, got[k].labels.split(","))) == base | labels, (k, texts[k])
        assert abs(got[k].score - max(score, 1.0 if base else 0.0)) < 1e-9


def test_edited_licences_are_found_and_loose_words_are_not(spark):
    texts, truth = documents()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scanned(docs).collect()}
    found = sum(len(truth[k] & got[k]) for k in range(len(texts)))
    assert found / sum(map(len, truth)) > 0.95
    # labels that aren't planted come only with others of their family or as base labels
    assert all(not got[k] - {"cc-by", "gpl", "reserved"} for k in range(len(texts)) if not truth[k] and k < 240)


def test_given_documents_equal_the_plain_version(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    got = {r.doc_id: r for r in licenses.query(spark, "/root/testdata/sf0.001").collect()}
    hits = 0
    for (i, _), (labels, _) in zip(rows, plain([t for _, t in rows])):
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == base | labels
        hits += bool(labels)
    assert hits >= 3
