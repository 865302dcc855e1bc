"""The pipeline against a plain version, stage by stage."""

import base64
import hashlib
from collections import Counter

import public_tokenizers

import corpus_pipeline
from polystore.llm import queries
from tests.llm import brute


def plain_pipeline(rows):
    """(doc_id, text, source) after quality, lines and near-dedup."""
    kept = [(i, clean, s) for i, t, s in rows if (clean := brute.cleaned(t or "")) is not None]
    gone = brute.removed_lines(kept)
    left = []
    for i, t, s in kept:
        cut = gone.get((i, t), {})
        text = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in cut)
        if not cut or brute.words(text):
            left.append((i, text, s))
    left.sort()
    roots = brute.components([t for _, t, _ in left], brute.alike)
    return [r for k, r in enumerate(left) if roots[k] == k]


def plain_targets(rows):
    """{source: (size, target)}: 150% of all words by the weights 5, 2, 1, at most twice a source's own."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(brute.words(t))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left, open_ = left - sum(2.0 * size[s] for s in over), open_ - over
    return {s: (size[s], target[s]) for s in size}


def test_pipeline(spark, small):
    import tiktoken

    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = plain_pipeline([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    at = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = spark.createDataFrame(stage(spark, at, small).collect(), docs.schema)
        assert at.columns == docs.columns, name
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in at.collect()) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {}
    for i, t, _ in want:
        ids = library.encode_ordinary(t)
        rows[i] = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    result = corpus_pipeline.run(spark, small)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result.collect())
    assert set(got) <= set(rows.values())
    targets = plain_targets(want)
    for source, (size, target) in targets.items():
        own = [(i, len(brute.words(t))) for i, t, s in want if s == source]
        ratio = target / size if size else 0
        assert all(got[rows[i]] in (int(ratio), int(ratio) + 1, round(ratio)) for i, n in own)
        assert abs(sum(got[rows[i]] * n for i, n in own) - target) <= max(n for _, n in own)


def test_stages_on_hard_and_empty_tables(spark, small):
    for rows in (brute.hard_rows(), []):
        docs = spark.createDataFrame(rows, brute.DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, small)
            assert docs_out.columns == docs.columns
            docs = spark.createDataFrame(docs_out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())
