"""The pipeline over the smallest tables, stage by stage, against brute force on each stage's own input."""

from __future__ import annotations

import re
import zlib

import numpy as np

import corpus_pipeline
from tarnmill.llm import decontaminate, jaccard, quality
from tarnmill.llm.queries import tokenizer_path
from tarnmill.runtime import materialise
from tests.conftest import DATA


def ids(df) -> list[int]:
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialise(stage(spark, kept[-1], DATA)))
        assert kept[-1].columns == columns and 0 < kept[-1].count() <= kept[-2].count()

    scores = quality.score_documents(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(kept[1]) == ids(scores.where("predicted = 1"))

    least: dict[str, int] = {}
    for r in kept[1].collect():
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        least[norm] = min(least.get(norm, r["doc_id"]), r["doc_id"])
    assert ids(kept[2]) == sorted(least.values())

    near = jaccard.plain_components([(r["doc_id"], r["text"]) for r in kept[2].collect()])
    assert ids(kept[3]) == sorted(k for k, n, c in near if k == c or not n)

    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = decontaminate.plain_contamination([(r["doc_id"], r["text"]) for r in kept[3].collect()], items)
    assert ids(kept[4]) == sorted(x[0] for x in leaks if not x[-1]) and len(ids(kept[4])) < len(leaks)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept[4].collect()}
    pieces = corpus_pipeline.run(spark, DATA).toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == want
    ids_of = {r["doc_id"]: np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in kept[4].collect()}
    for r in pieces.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids_of[r.doc_id][r.start : r.start + r.length].tobytes())
    placed = pieces.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_nulls_repeats_and_emptiness(spark, tmp_path):
    """Null ids and texts, one id on two texts, repeated rows, extra columns with helpers' names; then no documents at all."""
    words = [f"w{k}" for k in range(400)]
    a, b, leak = " ".join(words[:80]) + ".", " ".join(words[100:180]) + ".", " ".join(words[300:330])
    rows = [(5, a), (5, b), (5, a), (6, a.replace("w7 ", "x ")), (7, None), (8, ""), (None, " ".join(words[200:260])), (None, None), (9, b.upper() + " " + leak), (10, leak + " and more"), (11, " \t")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _keep int, _marks int, _score int"
    for name, docs in (("full", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame([(i, t, "en", "s", 1, 1, 1, 1) for i, t in docs], schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")  # without labels every row scores one half
        spark.createDataFrame([("i", leak), ("j", None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        kept = spark.read.parquet(f"{d}/documents.parquet")
        sizes = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = materialise(stage(spark, kept, d))
            assert kept.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
            sizes.append(kept.count())
        pieces = corpus_pipeline.run(spark, d)
        if not docs:
            assert sizes == [0] * 4 and pieces.count() == 0
            continue
        left = sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:4]) for r in kept.collect())
        # equal texts: a twice, the empty ones (null, empty; white space is one space); near copies: a of 6, b of 9; leaks: 9 and 10
        assert left == [(-1, "w200"), (5, "w0 w"), (5, "w100"), (7, ""), (11, " \t")] and sizes == [11, 8, 7, 5]
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in pieces.collect()) == [-1, 5, 5, 7, 11]
