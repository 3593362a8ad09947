"""Text functions, similarity, signatures, candidates, clusters, cards, measures, streams."""

from __future__ import annotations

import re
import unicodedata
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.functions import columns as C
from tarnmill.operators import dedup as D
from tarnmill.operators import evaluate as V
from tarnmill.operators.components import connected_components
from tarnmill.plans.pipelines import dedup_run, dedup_with_cards
from tarnmill.queries import notices as N
from tarnmill.sources import readers
from tarnmill.streaming import arrivals


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["Héllo, Wörld! ﬁne 한국 a_b 1.5", "", None, "  A\t\nB ", "x²³ Ⅷ"])
def test_clean_text(spark, text):
    want = ""
    if text:
        want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", text).lower())).strip()
    assert one(spark, C.clean_text("t"), t=text) == want


def test_boilerplate(spark):
    npas = "NATIONAL PROCUREMENT AGGREGATION SERVICE portal rules\nand TERMS AND CONDITIONS Tender for road works"
    assert one(spark, C.strip_boilerplate("t", "p"), t=npas, p="P001") == "Tender for road works"
    assert one(spark, C.strip_boilerplate("t", "p"), t="State Procurement Cell notice APPLICABLE LAW Supply of pumps DISCLAIMER: no WARRANTY given\nkept", p="P003") == "Supply of pumps kept"
    assert one(spark, C.strip_boilerplate("t", "p"), t="plain  text", p="P900") == "plain text" and one(spark, C.strip_boilerplate("t"), t=None) == ""


def test_grams_and_jaccard(spark):
    assert set(one(spark, C.char_ngrams("t", 3), t="abcde")) == {"abc", "bcd", "cde"} and one(spark, C.char_ngrams("t", 3), t="ab") == ["ab"] and one(spark, C.char_ngrams("t"), t="") == []
    assert set(one(spark, C.char_ngram_range("t", 2, 3), t="abcd")) == {"ab", "bc", "cd", "abc", "bcd"}
    assert one(spark, C.word_tokens("t"), t="a bb cc bb") == ["bb", "cc"]
    a, b, none = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "cde")), F.array().cast("array<string>")
    assert one(spark, C.jaccard(a, b)) == 0.2 and one(spark, C.jaccard(none, none)) == 1.0 and one(spark, C.jaccard(a, none)) == 0.0
    assert abs(one(spark, C.weighted_similarity(F.lit(0.5), F.lit(1.0))) - 0.65) < 1e-12 and one(spark, C.weighted_similarity(F.lit(0.5))) == 0.5
    for text in ("abcdefg abc", "ab", "éé字字字", ""):
        grams = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)} or ({text} if text else set())
        assert len(D.gram_hashes(text, 3, 5)) == len(grams)


def test_gram_counts(spark):
    """Counts of grams without their texts equal the sizes of the arrays of them."""
    texts = ["Hello, WORLD! hello world 12", "", None, "é", "ab", "a-b", " . ", "abcabcabcabc", "\u212aelvin \u0130x", "x" * 50, "tab\tand\nline"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for low, high in ((3, 5), (1, 2), (4, 10)):
        assert all(r[0] == r[1] for r in df.select(C.ascii_gram_count("t", low, high), F.size(C.char_ngram_range(C.ascii_text("t"), low, high))).collect())
    assert C.count_ascii_grams("abcabcabc", 3, 5) == 9


def test_fields(spark):
    got = spark.range(1).select(*[v.alias(k) for k, v in C.field_compatibility(F.lit("45,00,000"), F.lit("4500000"), F.lit("2024-05-15"), F.lit("2024-05-20T10:00")).items()]).first()
    assert got["value_match"] and got["value_diff"] == 0.0 and got["closing_delta_days"] == 5
    bad = spark.range(1).select(*[v.alias(k) for k, v in C.field_compatibility(F.lit("n/a"), F.lit("1"), F.lit("soon"), F.lit(None).cast("string")).items()]).first()
    assert bad["value_diff"] is None and bad["closing_delta_days"] is None


def test_signatures(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2**63 - 1, 100), rng.integers(0, 2**63 - 1, 100)
    a, b = D.coefficients(128)
    direct = ((a.astype(object)[:, None] * (x % D.PRIME)[None] + b.astype(object)[:, None]) % D.PRIME).min(axis=1)
    assert (D.signature(x, a, b) == direct.astype(np.int64)).all() and (D.signature(x, a, b) == D.signature(x[::-1].copy(), a, b)).all()
    assert (D.signature(x, a, b) == D.signature(y, a, b)).mean() <= 0.05 and (D.signature(x[:0], a, b) == 0).all()
    df = spark.createDataFrame([(1, x.tolist()), (2, [])], "id int, shingles array<long>")
    both = D.with_signatures(df, m=16).withColumn("native", D.native_signature("shingles", 16)).collect()
    assert all(r["signature"] == r["native"] for r in both)
    assert one(spark, D.estimate(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == 0.5
    with pytest.raises(Exception, match="differ in length"):
        one(spark, D.estimate(F.array(F.lit(1)), F.array(F.lit(1), F.lit(3))))


def test_no_set_leaves_its_task(spark):
    """A notice's shingles are some 20 times its text: what is written holds texts and signatures alone."""
    from tarnmill.plans.pipelines import prepared

    ready = prepared(notices(spark), "notice_id", "portal_id", "title", "body")
    assert ready.schema["body"].dataType.simpleString() == "string" and ready.schema["signature"].dataType.simpleString() == "array<int>"
    for r in ready.collect():
        grams = D.gram_hashes(r["body"], 3, 5)
        assert r["n"] == len(grams) and r["signature"] == D.signature(grams, *D.coefficients(D.HASHES)).tolist()


def test_bands_and_candidates(spark):
    same, other = list(range(16)), list(range(100, 116))
    df = spark.createDataFrame([("A", same), ("B", same), ("C", other)], "id string, signature array<long>")
    store = D.bands(df, "id", b=4, r=4)
    assert store.count() == 12
    assert [tuple(r) for r in D.candidate_pairs(store, "id").collect()] == [("A", "B")]
    assert sorted(tuple(r) for r in D.lookup(store, store.where("id = 'A'"), "id").collect()) == [("A", "B")]
    with pytest.raises(Exception, match="shorter"):
        D.bands(df, "id", b=8, r=4).collect()
    many = spark.createDataFrame([(f"N{i:03d}", same) for i in range(50)], "id string, signature array<long>")
    capped = D.candidate_pairs(D.bands(many, "id", b=4, r=4), "id", 10, 10)
    assert capped.count() == sum(min(10, i) for i in range(50)) and capped.agg(F.max("id_a")).first()[0] == "N009"


def test_large_buckets_lose_no_pairs(spark, tmp_path):
    """70 copies fill one bucket of each band: every pair of them is verified, and every one has 69 candidates."""
    base = " ".join(f"word{i}" for i in range(40))
    docs = [(i, base, "s") for i in range(70)] + [(100, base + " one", "s"), (200, "something else altogether", "s"), (300, None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    keys = {r["doc_id"]: set(map(tuple, r["k"])) for r in N.store(spark, str(tmp_path)).groupBy("doc_id").agg(F.collect_list(F.array("band_idx", "bucket_key")).alias("k")).collect()}
    near = bool(keys[0] & keys[100])
    links = {r["doc_id"]: (r["class_id"], r["links"]) for r in N.verified_pairs(spark, str(tmp_path)).collect()}
    assert links == {**{i: (0, 69 + near) for i in range(70)}, 100: (100, 70 * near), 200: (200, 0), 300: (300, 0)}
    found = {r["doc_id"]: r for r in N.jaccard_pairs(spark, str(tmp_path)).collect()}
    assert found[0]["candidates"] == 69 + near and found[300]["mean_exact"] is None and (near or found[0]["mean_exact"] == found[0]["mean_estimated"] == 1)
    copies = {(a, b) for b in range(70) for a in range(b)}
    assert N.workload_skew(spark, str(tmp_path)).first()["total_comparisons"] >= 70 * 69
    assert sorted(r["size"] for r in N.duplicate_clusters(spark, str(tmp_path)).collect()) == [1, 1, *([71] if near else [1, 70])]
    store = N.store(spark, str(tmp_path))
    dealt = D._all_pairs(store, "doc_id", deal=7)  # ten salts
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, D.candidate_pairs(store, "doc_id").collect())) and dealt.count() >= len(copies)


def test_lookups_tell_a_candidate_once(spark, tmp_path):
    """Copies meet in all eight bands and are told once, as the search over the store tells them, without a step that tells pairs apart."""
    rng = np.random.RandomState(3)
    texts = [" ".join(f"w{x}" for x in rng.choice(12, 5)) for _ in range(150)]
    spark.createDataFrame([(i, texts[i % 75 if i % 2 else i], "s") for i in range(150)] + [(200, None, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = N.lsh_lookup(spark, str(tmp_path))
    store = N.store(spark, str(tmp_path))
    want = D.lookup(store, store.where("doc_id % 50 = 0"), "doc_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 20
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_what_may_be_similar_is_compared(monkeypatch):
    """Small buckets and large ones, parts of one, and sets of all sizes, against brute force; most pairs are settled by a bound."""
    import pyarrow as pa

    from tarnmill.operators import meetings as M

    rng = np.random.default_rng(11)
    bases = [rng.choice(3000, k, replace=False) for k in (2, 3, 40, 90, 200, 700)]
    sets, common = [], np.arange(600)
    for i in range(700):
        own = bases[i % 6] if i % 5 else rng.choice(3000, rng.integers(1, 500), replace=False)
        sets.append(np.unique(np.append(own[rng.random(len(own)) < 0.8], rng.integers(0, 3000, 1 + len(own) // 8))))
    keys, signature = rng.integers(0, 9, (700, 2)).astype("<u4"), rng.integers(0, 3, (700, 4)).astype("<u4")
    w, key = rng.integers(1, 4, 700), np.concatenate([np.full(300, 1), np.full(200, 2), np.sort(rng.integers(3, 30, 200))])
    j, part = np.repeat([0, 1, 0], [300, 200, 200]), np.where((np.arange(700) >= 300) & (np.arange(700) < 500), np.arange(700) % 2, 0)
    near, rest = zip(*[M._split(x, common, common) for x in sets])
    columns = {
        "band": pa.array(np.ones(700, np.int32)), "key": pa.array(key), "i": pa.array(np.zeros(700, np.int32)), "j": pa.array(j.astype(np.int32)), "part": pa.array(part.astype(np.int32)), "id": pa.array(np.arange(700) * 3), "w": pa.array(w),
        "n": pa.array([len(x) for x in sets], pa.int32()), "keys": pa.array([x.tobytes() for x in keys]), "signature": pa.array([x.tobytes() for x in signature]), "near": pa.array(near), "rest": pa.array(rest),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    met = [(a, b) for a in range(700) for b in range(a + 1, 700) if key[a] == key[b] and keys[a, 0] != keys[b, 0] and (not j[a] or part[a] != part[b])]
    common_of = [len(np.intersect1d(sets[a], sets[b])) for a, b in met]
    similar = [c / (len(sets[a]) + len(sets[b]) - c) >= 0.5 for (a, b), c in zip(met, common_of)]
    want: dict = {}
    for (a, b), yes in zip(met, similar):
        cell = int((signature[a] == signature[b]).sum()), int(yes)
        want[cell] = want.get(cell, 0) + int(w[a] * w[b])
    compared = []
    for name, at in (("sure", 3), ("common", 1)):
        monkeypatch.setattr(M.Lot, name, lambda self, *x, f=getattr(M.Lot, name), at=at: (compared.append(len(x[at - 1])), f(self, *x))[1])
    got = M._alike(M.Lot(batch, 2, 4, 0.5), 4)
    assert {(s, k): n for s, k, n in zip(got["same"].tolist(), got["similar"].tolist(), got["pairs"].tolist())} == want
    assert any(similar) and sum(compared) < 2 * sum(similar) + len(met) // 4
    edges = M._spanning(M.Lot(batch, 2, 4, 0.5), 4)
    label = list(range(700))
    for group in ([(a, b) for (a, b), yes in zip(met, similar) if yes], [(a // 3, b // 3) for a, b in zip(edges["id_a"].tolist(), edges["id_b"].tolist())]):
        now = list(range(700))
        for _ in range(30):
            for a, b in group:
                now[a] = now[b] = min(now[a], now[b])
        label, before = now, label
    assert label == before and len(edges["id_a"]) < 700


def test_a_bucket_travels_whole(spark, monkeypatch):
    """9,000 rows of one bucket go to one task, once each, without the signatures that spanning edges do not need."""
    from tarnmill.operators import meetings as M

    monkeypatch.setitem(M.PURPOSES, "spanning", (lambda lot, m: {"id_a": np.array([len(lot.id)]), "id_b": np.array([lot.signature.size])}, "id_a long, id_b long"))
    rows = spark.range(9_000).selectExpr("id", "1L as w", "1 as n", "cast('same' as binary) as keys", "cast('sign' as binary) as signature", "cast('' as binary) as near", "cast('' as binary) as rest")
    assert [tuple(r) for r in M.meetings(rows, 1, 1, "spanning").collect()] == [(9_000, 0)]


def test_meetings(spark):
    """Buckets cut into parts and tiles, and copies, against brute force over all pairs."""
    from tarnmill.operators import meetings as M

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.choice(12, 4)) for _ in range(90)]
    docs = [(i, t) for i, t in enumerate([*texts, *texts[:20], "", None])]
    rows = M.word_sets(spark.createDataFrame(docs, "doc_id long, text string"), "text", 4, 1).where("n > 0").localCheckpoint()
    full = {r["doc_id"]: (frozenset(np.frombuffer(r["tokens"], "<u4")), [r["keys"][k : k + 4] for k in range(0, 16, 4)], np.frombuffer(r["signature"], "<u4")) for r in rows.collect()}
    pairs = {(a, b): len(full[a][0] & full[b][0]) / len(full[a][0] | full[b][0]) for a in full for b in full if a != b and any(x == y for x, y in zip(full[a][1], full[b][1]))}
    alike = rows.groupBy("keys").agg(F.count(F.lit(1)).alias("w"))
    counts = rows.select("doc_id", "keys").join(M.partner_counts(alike, 4), "keys").collect()
    assert {r["doc_id"]: r["partners"] - 1 for r in counts} == {a: sum(x == a for x, _ in pairs) for a in full}
    groups = rows.groupBy("told").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("w"))
    one = M.shortened(rows.drop("told")).join(groups.select("id", "w"), F.col("doc_id") == F.col("id")).drop("doc_id").localCheckpoint()
    w = {r["id"]: r["w"] for r in one.collect()}
    for deal, tile in ((8_000, 768), (11, 768), (8_000, 5)):
        M.TILE, before = tile, M.TILE
        try:
            sums = {r["id"]: r for r in M.meetings(one, 4, 1, "rows", deal=deal).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("met", "same", "exact", "similar")]).collect()}
            cells = M.meetings(one, 4, 1, "similarity", deal=deal).groupBy("similar").agg(F.sum("pairs").alias("pairs")).collect()
            edges = [tuple(r) for r in M.meetings(one, 4, 1, "spanning", deal=deal).collect()]
        finally:
            M.TILE = before
        for a in w:
            met = {b: e for (x, b), e in pairs.items() if x == a and full[b][0] != full[a][0]}
            want = (len(met), sum(int((full[a][2] == full[b][2]).sum()) for b in met), sum(int(e * 1e6 + 0.5) for e in met.values()), sum(e >= 0.5 for e in met.values()))
            assert tuple(sums[a][c] for c in ("met", "same", "exact", "similar")) == want if met else a not in sums or not sums[a]["met"]
        told = {k: sum(w[a] * w[b] for (a, b), e in pairs.items() if a < b and a in w and b in w and (e >= 0.5) == k) for k in (False, True)}
        assert {bool(r["similar"]): r["pairs"] for r in cells} == {k: v for k, v in told.items() if v}
        assert all(pairs[e] >= 0.5 for e in edges)
        joined, wanted = (dict(zip(w, w)) for _ in range(2))
        for label, links in ((joined, edges), (wanted, [p for p, e in pairs.items() if e >= 0.5 and p[0] in w and p[1] in w])):
            for _ in w:
                for a, b in links:
                    label[a] = label[b] = min(label[a], label[b])
        assert joined == wanted


def test_sweep_counts_pairs_where_they_meet(spark):
    """Parts, tiles, ranges and their ends against brute force over all pairs and all neighbours."""
    from tarnmill.operators import meetings as M

    rng = np.random.RandomState(5)
    texts = [" ".join(f"w{x}" for x in rng.choice(rng.choice([40, 300, 3000]), rng.choice([3, 30, 200]))) for _ in range(120)]
    texts += [f"{t} more{k}" for k, t in enumerate(texts[:60])]
    rows = [(int(i), [None, "a", "b"][i % 3], t) for i, t in enumerate(texts)]
    sets = M.word_sets(spark.createDataFrame(rows, "id long, lang string, text string").repartition(3), "text", 1, 1)
    tokens = {r["id"]: np.frombuffer(r["tokens"], "<u4").astype(np.int64) for r in sets.collect()}
    configs, (a, b) = [(64, 4), (8, 32)], D.coefficients(D.HASHES)
    signed = {i: D.signature(t, a, b) for i, t in tokens.items()}

    def counted(pairs):
        return [len(pairs), *[sum(bool((signed[i] == signed[j]).reshape(x, y).all(axis=1).any()) for i, j in pairs) for x, y in configs]]

    alike = lambda i, j: 3 * len(np.intersect1d(tokens[i], tokens[j])) >= len(tokens[i]) + len(tokens[j])
    common = M.frequent(sets)[:500]
    one = M.shortened(sets, common)
    agreement = M.Agreement(common, configs, D.HASHES)
    want = counted([(i, j) for j in range(len(texts)) for i in range(j) if alike(i, j)])
    assert want[0] >= 60
    for part in (len(texts), 40, 7):
        assert M.similar_found(one, agreement, part, 1).tolist() == want
    assert M.beside_found(one, "lang", agreement).tolist() == counted([(i, i + 3) for i in range(len(texts) - 3) if not alike(i, i + 3)])


def test_components(spark):
    def found(edges):
        return {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}

    assert found([(i, i + 1) for i in range(40)] + [(90, 80), (80, 90), (70, 70), (5, 5)]) == {**{i: 0 for i in range(41)}, 80: 80, 90: 80, 70: 70}
    assert found([]) == {}
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 120, (90, 2))]
    label = {n: n for e in edges for n in e}
    for _ in range(120):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found(edges) == label


def test_cards(spark):
    assert one(spark, C.card_id("k"), k="N10") == "CARD-" + str(uuid.uuid5(uuid.UUID(C.CARD_NAMESPACE), "N10"))[:16] == "CARD-336b8068-30f1-52"
    empty = spark.createDataFrame([], "notice_id string, card string")

    def run(groups, state):
        cards, after = D.assign_cards(spark.createDataFrame([(n, min(g)) for g in groups for n in g], "notice_id string, lead string"), state, "notice_id")
        return {r["notice_id"]: r["card"] for r in cards.collect()}, after

    first, state = run([["N10", "N11"], ["N20", "N21", "N22"]], empty)
    again, _ = run([["N10", "N11"], ["N20", "N21", "N22"]], state)
    assert first == again and first["N10"] == first["N11"] != first["N20"]
    grown, _ = run([["N10", "N11", "N12"]], state)
    assert grown["N12"] == first["N10"]
    merged, after = run([["N10", "N15", "N20"]], state)
    assert set(merged.values()) == {min(first["N10"], first["N20"])} and after.count() == 6  # N11, N21, N22 keep theirs
    split, _ = run([["N20"], ["N21", "N22"]], state)
    assert set(split.values()) == {first["N20"]}


def notices(spark):
    body = "Construction of a two lane road with drains and culverts between the old market and the river bridge in the eastern district of the city"
    rows = [("N1", "P001", body + " phase one", "Road works", "45,00,000", "2024-05-15"), ("N2", "P009", body + " phase one.", "Road works", "4500000", "2024-05-20"), ("N3", "P009", body + " phase one!", "Road works", "9", "2024-05-20"), ("N4", "P009", body + " phase one?", "Road works", None, "2024-09-20"), ("N5", "P009", "Supply of laboratory glass for the college", "Glass", None, None), ("N6", "P009", None, None, None, None)]
    df = spark.createDataFrame(rows, "notice_id string, portal_id string, body string, title string, estimated_value string, closing_date string")
    return df.withColumns({"estimated_value": C.plain_number("estimated_value"), "closing_date": C.iso_day("closing_date"), "published_at": F.lit("2024-05-01T00:00")})


def test_dedup_run(spark, tmp_path):
    edges, found = dedup_run(notices(spark))
    assert [(r["id_a"], r["id_b"]) for r in edges.collect()] == [("N1", "N2")]  # N3's value and N4's closing date keep them apart
    assert {r["notice_id"]: r["lead"] for r in found.collect()} == {"N1": "N1", "N2": "N1", "N3": "N3", "N4": "N4", "N5": "N5", "N6": "N6"}
    root = str(tmp_path / "cards")
    cards = [{r["notice_id"]: r["stable_card_id"] for r in dedup_with_cards(notices(spark), root).collect()} for _ in range(2)]
    assert cards[0] == cards[1] and cards[0]["N1"] == cards[0]["N2"] and len(set(cards[0].values())) == 5


def test_dedup_run_has_no_caps(spark):
    """250 different texts of one bucket: every pair is a link (caps of 100 a bucket and 200 a notice lost some). Copies hang on the smallest id."""
    base = " ".join(f"tender{i} item{7 * i}" for i in range(40))
    rows = [(i, "p", "Same title", f"{base} {chr(97 + i % 26)}{i}", 5.0 if i % 2 else None, None) for i in range(250)]
    rows += [(1000 + i, "p", "Same title", rows[3][3], 5.0, None) for i in range(6)] + [(2000, "p", "Same title", rows[3][3], 9.0, None), (3000, "p", "", "", None, None), (3001, "p", None, None, None, None)]
    df = spark.createDataFrame(rows, "notice_id long, portal_id string, title string, body string, estimated_value double, closing_date date")
    edges, found = dedup_run(df)
    got = sorted((r["id_a"], r["id_b"]) for r in edges.collect())
    want = {(a, b) for b in range(250) for a in range(b)} | {(3, 1000 + i) for i in range(6)} | {(i, 2000) for i in range(0, 250, 2)}
    assert got == sorted(want) and all(r["score"] == 1.0 for r in edges.where("id_b between 1000 and 1999").collect())
    assert {r["lead"] for r in found.where("notice_id <= 2000").collect()} == {0} and found.where("notice_id >= 3000 and lead = notice_id").count() == 2


def test_measures(spark):
    df = spark.createDataFrame([(i, float(i), i % 2 == 0, f"s{i % 3}") for i in range(1, 11)], "id int, x double, pos boolean, g string")
    d = V.distribution(df, "x").first()
    assert d["p50"] == 5.5 and abs(d["std"] - np.std(range(1, 11))) < 1e-12 and abs(d["p95"] - np.percentile(range(1, 11), 95)) < 1e-12
    ties = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "s double, p boolean")
    assert V.auc(ties, "s", "p").first()["auc"] == 0.875
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("a", "b"), ("a", "zz")], "notice_id_a string, notice_id_b string")
    h = V.pair_hygiene(pairs, spark.createDataFrame([("a",), ("b",)], "id string"), "id").first()
    assert (h["pairs"], h["self_pairs"], h["duplicate_pairs"], h["reversed_pairs"], h["missing_pairs"]) == (5, 1, 1, 1, 1)
    w = V.workload(df.select("id", F.col("id").cast("long").alias("w")), "w", "id").first()
    assert w["top_10_pct_work"] == 18.18 and w["total_comparisons"] == 55 and w["top_1_pct_work"] == 18.18
    assert [r["cumulative_pct"] for r in V.lorenz(df, "id", "x").orderBy("place").limit(2).collect()] == [18.181818, 34.545455]
    assert V.sample_size() == 385 and V.chebyshev_size() == 2000
    buckets = V.tenth_buckets(spark.createDataFrame([(1.0,), (0.95,), (0.05,)], "v double"), "v", F.count(F.lit(1)), "m").orderBy("bucket").collect()
    assert [r["n"] for r in buckets] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    labelled = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("a", "d", False)], "id_a string, id_b string, same boolean")
    sweep = V.retrieval_sweep(labelled, {(64, 4): labelled.where("id_b <> 'x'").select("id_a", "id_b"), (8, 32): labelled.where("id_b = 'b'").select("id_a", "id_b")})
    got = {r["bands"]: r for r in sweep.collect()}
    assert got[64]["recall"] == 1.0 and got[64]["risk"] == 0.5 and got[8]["recall"] == 0.5 and V.operating_point(sweep).first()["bands"] == 64
    before, after = (spark.createDataFrame([("m", v), ("z", 0.0)], "metric string, value double") for v in (4.0, 3.0))
    assert {r["metric"]: r["change"] for r in V.before_after(before, after).collect()} == {"m": "-25.00%", "z": "N/A"}
    curve = {(r["bands"], round(r["similarity"], 2)): r["probability"] for r in V.s_curve_table(spark, [(32, 8)]).collect()}
    assert curve[32, 0.0] == 0 and curve[32, 1.0] == 1 and 0.4 < curve[32, 0.65] < 0.95
    assert [r["is"] for r in spark.createDataFrame([("ABC 1",), ("AbC",), ("1",)], "t string").select(V.is_upper(F.col("t")).alias("is")).collect()] == [True, False, False]


def test_readers(spark, tmp_path):
    d = tmp_path / "n"
    d.mkdir()
    (d / "b.csv").write_text('notice_id,portal_id,published_at,title,body,estimated_value,closing_date\nN1,P1,2024-01-02,,x,"1,000",never\n')
    row = readers.read_notices(spark, str(d)).first()
    assert row["title"] == "" and row["estimated_value"] == 1000.0 and row["closing_date"] is None
    with pytest.raises(FileNotFoundError):
        readers.read_notices(spark, str(tmp_path))
    (tmp_path / "l.csv").write_text("notice_id_a,notice_id_b,label\n N1 ,N2, SAME\n")
    label = readers.read_label_pairs(spark, str(tmp_path / "l.csv")).first()
    assert (label["notice_id_a"], label["label"], label["adjudicated_by"]) == ("N1", "same", "")
    readers.register(spark.range(3), "three")
    assert "three" in readers.table_names(spark)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    lines = spark.createDataFrame([("b1", 1, "2024-01-01 10:00:00", 5.0), ("b1", 1, "2024-01-01 11:00:00", 9.0), ("b2", 1, "2024-01-02 10:00:00", 1.0)], "bill string, line int, t string, revenue double").withColumn("ts", F.to_timestamp("t")).drop("t")
    lines.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(lines.schema).parquet(str(src))
    q = arrivals.first_arrivals(stream, ["bill", "line"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select count(*) from firsts").first()[0] == 2
    root = str(tmp_path / "cards")
    n = spark.createDataFrame([("N1", "N1"), ("N2", "N1")], "notice_id string, lead string")
    n.write.parquet(str(tmp_path / "notices"))
    for k in range(2):
        q = arrivals.follow_cards(spark.readStream.schema(n.schema).parquet(str(tmp_path / "notices")), root, str(tmp_path / f"ck{k}"), lambda b: b)
        q.awaitTermination(60)
    from tarnmill.sources.writers import latest_version

    state = spark.read.parquet(latest_version(spark, root)).collect()
    assert len(state) == 2 and len({r["card"] for r in state}) == 1
