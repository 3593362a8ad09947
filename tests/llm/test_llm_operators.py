"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import chat, decontaminate, exact, jaccard, licenses, lmscore, packing, quality, repeats, sharding, templates, wordscan
from tarnmill.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, _hash int, _keep int, _marks int, _score int, _text int, _id int, cid int"


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, one word, no words, nulls, control characters, one very long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]

    def prose(n: int) -> list[str]:
        return [r.choice(vocabulary) for _ in range(n)]

    base, passage = prose(120), prose(60)
    docs = [" ".join(base)] * 4
    for _ in range(12):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append(" ".join(w))
    docs += [" ".join(prose(30) + passage + prose(20)) for _ in range(5)]
    docs += [" ".join(prose(n)) for n in (1, 2, 3, 4, 5, 6, 35, 36, 80)]
    docs += ["same", "SAME", "a b c", "A  b\tc", "  spaced\n out ", "", " \t\n", None, "one\x0btwo\x1cthree four", "la " * 90, "ab " * 40 + "x", " ".join(prose(9000))]
    rows = [(i, t, *[1] * 7) for i, t in enumerate(docs)]
    return [*rows, rows[0], (None, "nobody knows", *[1] * 7), (None, None, *[1] * 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def known() -> list[tuple]:
    return [(i, t) for i, t, *_ in corpus() if i is not None]


def test_words_are_those_of_a_plain_split():
    texts = [t for _, t, *_ in corpus()]
    for alphabet in (wordscan.PLAIN_WORDS, wordscan.FOLDED_WORDS, wordscan.FOLDED_ALNUM):
        named: dict = {}
        for words in wordscan.scan(pa.array(texts, pa.string()).slice(1), alphabet):
            for d in range(len(words.counts)):
                own = words.hashes[words.offsets[d] : words.offsets[d + 1]].tolist()
                want = wordscan.plain_words(texts[1 + words.first + d], alphabet)
                assert len(own) == len(want)
                assert all(named.setdefault(w, h) == h for w, h in zip(want, own))
        assert len(set(named.values())) == len(named)


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, 24).toPandas()
    assert len(got) == len(corpus())
    texts = {i: t or "" for i, t in known()}
    for r in got[got.doc_id.notna()].itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "key"
    assert set(got.grown_shard[got.shard != got.grown_shard]) <= {24}
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert sharding.assign_shards(empty, 24).count() == 0


def test_jump_moves_the_fair_share():
    keys = np.arange(100_000, dtype=np.uint64)
    a, b = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.003
    assert np.bincount(a).min() > 0.9 * len(keys) / 24 and (sharding.jump(keys, 1) == 0).all()


def test_quality_learns_and_is_whole(spark, empty):
    good, bad = "The quick brown fox jumps over the lazy dog and runs. ", "BUY!! NOW$$$ cheap### "
    rows = [(i, (good if i % 3 else bad) * (i % 7 + 1) + str(i)) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(250)] + [(5, None), (777, 1)], "doc_id long, quality int")
    got = quality.score_documents(df, labels).toPandas()
    assert len(got) == 304 and got.score.between(0, 1).all() and got.score.notna().all()
    own = got[(got.doc_id < 300) & got.held_out]
    assert len(own) > 40 and (own.predicted == [1 if i % 3 else 0 for i in own.doc_id]).mean() > 0.97
    assert all(r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0) for r in own.itertuples())
    assert (got.predicted == (got.score >= 0.3)).all()
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.score_documents(df, labels.where("false")).toPandas().score.nunique() == 1


def test_statistics_do_not_depend_on_neighbours():
    texts = [t for _, t, *_ in corpus()]
    together = quality.document_statistics(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.document_statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and together.shape[1] == len(quality.FEATURES)


def plain_statistics(text: str | None) -> list[float]:
    """The statistics of one text from lists and counters."""
    raw = (text or "").encode()
    words = wordscan.plain_words(text, wordscan.FOLDED_WORDS)
    n, size = len(words), len(raw)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = (max(sum(x * x for x in lengths) / max(n, 1) - mean * mean, 0)) ** 0.5
    lines = [tuple(w) for w in (wordscan.plain_words(x, wordscan.FOLDED_WORDS) for x in (text or "").split("\n")) if w]
    pairs = {(a, b) for a, b in zip(words, words[1:])}
    kinds = {k: sum(any(a <= x <= b for a, b in ranges) for x in raw) / max(size, 1) for k, ranges in quality._CLASSES.items()}
    marked = sum(any(a <= w[-1] <= b for k in ("bang", "symbol") for a, b in quality._CLASSES[k]) for w in words)
    most = lambda x: max(Counter(x).values(), default=0)
    return [
        np.log1p(n), np.log1p(size), mean, spread, np.log1p(max(lengths, default=0)), len(set(words)) / max(n, 1), most(words) / max(n, 1), len(set(lines)) / max(len(lines), 1), most(lines) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)), sum(x <= 2 for x in lengths) / max(n, 1), sum(x >= 12 for x in lengths) / max(n, 1), 1 - len(pairs) / max(n - 1, 1), *kinds.values(), marked / max(n, 1),
    ]


def test_statistics_are_those_of_a_plain_count():
    texts = [t for _, t, *_ in corpus()] + ["One line!\nTwo  lines; two\n\none LINE!\n", "#a $b c? d!", "\n\n", "x" * 300 + " y"]
    got = quality.document_statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-6)


def test_the_first_split_is_the_best_one():
    """Of all features and cuts of the quantile bins the one with the largest gain, found by trying each."""
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 3))
    y = (x[:, 1] > 0.4).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, bins=16)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gains = {}
    for k in range(3):
        for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 17)[1:-1])):
            left = x[:, k] <= cut
            gains[k, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
    best = max(gains, key=gains.get)
    assert (model.feature[0, 0], model.cut[0, 0]) == best
    left = x[:, best[0]] <= best[1]
    assert np.allclose(model.leaf[0], [-0.15 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_labels_are_learned_once_each(spark):
    """Documents that repeat an id, and labels that contradict themselves, count once; the bound holds."""
    docs = spark.createDataFrame([(i % 50, f"{'good words here' if i % 2 else 'BAD!!! $$$'} {i % 50}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda x, y, *a, **k: seen.append((len(x), y.sum())) or fit(x, y, *a, **k)
    try:
        quality.train(docs, labels)
        quality.train(docs, labels, rows=7)
    finally:
        quality.fit = fit
    learned = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert seen[0] == (len(learned), sum(i % 2 for i in learned if i != 1)) and seen[1][0] == 7
    clash = docs.select("doc_id", "text", F.lit(1).alias("_score"), F.lit("x").alias("quality"))
    kept = quality.keep_good(clash.unionByName(clash.where("false")), labels)
    assert kept.columns == clash.columns and 0 < kept.count() <= 500 and quality.keep_good(clash.where("false"), labels).count() == 0


def test_trees_flatten_to_what_a_walk_finds():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=30, depth=3)
    p = model.score(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.95
    for row, want in zip(x[:20], p[:20]):
        total = model.start
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > c[k])
            total += leaf[k - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - want) < 1e-12


CHATS = [(1, 0, "system", "be\\ nice"), (1, 1, "user", "hi [INST] there"), (1, 2, "assistant", "</s><s>[/INST]\\"), (1, 2, "assistant", "tie"), (2, 0, None, None), (2, 1, "[ROLE]x", "a[/ROLE]"), (2, 2, "assistant", ""), (None, 5, "user", "é" * 3000), (3, None, "assistant", "null turn"), (3, None, "assistant", "null turn")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*c, "x") for c in CHATS], "conv_id long, turn long, role string, text string, messages string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df, sink="digest").collect()}
    whole = {r["conv_id"]: r for r in chat.format_conversations(df, sink="text").collect()}
    by: dict = {}
    for c, t, role, text in sorted(CHATS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        text = whole[c]["formatted"]
        assert got[c]["formatted_chars"] == len(text)
        assert chat.unescape("".join(text[s["begin"] : s["end"]] for s in whole[c]["trained"])) == loss
        reader = chat.TurnReader()
        assert [x for at in range(0, len(text), 7) for x in reader.feed(text[at : at + 7])] == turns
        assert list(chat.TurnReader().feed(text)) == turns
    assert chat.format_conversations(df.where("false"), sink="digest").count() == 0


def test_escapes_hold_no_control_strings():
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice([*chat.CONTROLS, "\\", "[", "<", "/s>", "x"]) for _ in range(r.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_template_language():
    def render(source, **env):
        return "".join(t for t, _ in templates.compile_template(source)(env))

    assert render("{% for x in xs %}{{ loop.index }}{{ x.a ~ '!' }}{% if loop.first %},{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": 2}]) == "11!,22!"
    assert render("{% set y = 2 * 3 %}{{ y if y > 5 and not false else 'no' }}{# gone #}{{ 'Ab' | upper | length }}") == "62"
    assert [render("{% if a == 1 %}one{% elif a in xs %}x{% else %}{{ a }}{% endif %}", a=k, xs=[2]) for k in (1, 2, 3)] == ["one", "x", "3"]
    assert templates.fold_block(templates.parse("a{{ 'b' ~ 1 }}{% if 1 < 2 %}c{% else %}{{ x }}{% endif %}", {})) == [templates.Text("ab1c")]
    assert render("{{ 2 * 3 % 4 }}{{ 'a' + 'b' }}") == "2ab"
    for endless in ("{{ 'x' * 1000000000 }}", "{{ '%999999999d' % 1 }}", "{{ 9999999999 * 9999999999 * 9999999999 }}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(endless)
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{{ x | nothing }}", "{% for x in y %}", "{{ }}", "{% import os %}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad)


def test_packing(docs, empty):
    got = packing.pack(docs, tokenizer_path(), capacity=256, payload="ids").toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, tuple(ids)] += 1
    pieces: Counter = Counter()
    for key, own in got.assign(k=got.doc_id.fillna(-1)).groupby(["k", "doc_tokens"]):
        for start, same in own.groupby("start"):
            for r in same.itertuples():
                assert r.length == len(r.ids) <= 256
                pieces[key[0], start, tuple(r.ids)] += 1
    for (i, ids), n in want.items():
        for s in range(0, len(ids), 256):
            assert pieces[-1 if i is None else i, s, ids[s : s + 256]] >= n
    assert sum(pieces.values()) == sum(-(-len(ids) // 256) * n for (_, ids), n in want.items())
    at = got.sort_values(["sequence_id", "offset"])
    assert (at.offset == at.groupby("sequence_id").length.cumsum() - at.length).all() and at.groupby("sequence_id").length.sum().max() <= 256
    assert packing.sequences(packing.pack(docs, tokenizer_path(), capacity=256)).count() == got.sequence_id.nunique()
    assert packing.pack(empty, tokenizer_path()).count() == 0
    crc = packing.pack(docs, tokenizer_path(), payload="ids_crc32").where("doc_id = 33").first()
    assert crc["ids_crc32"] == zlib.crc32(np.array([*tok.encode("same", add_special_tokens=False).ids, 1] if crc["doc_tokens"] == 2 else [*tok.encode(dict(known())[33] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    texts = [t or "" for _, t, *_ in corpus()] + ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext", " " * 1_000_000, " " * 5_000_000 + "x", "\n \t" * 400_000, "x" * 1_000_000]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encode("a<|endoftext|>b"), "<u4")


def test_packing_query_against_brute_force(spark):
    """op4 over a whole table: every column but the free choice of places, and what places must fulfil."""
    from tokenizers import Tokenizer

    from tarnmill.llm.queries import op4_packing
    from tests.conftest import DATA

    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], np.array(ids, "<u4")))
    got = op4_packing(spark, DATA).toPandas().sort_values(["doc_id", "start"])
    by = {k: v for k, v in got.groupby("doc_id")}
    assert by.keys() == {k for k, _ in want}
    for k, ids in want:
        at = 0
        for r in by[k].itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all() and placed.groupby("sequence_id").length.sum().max() <= 2048
    assert got.length.sum() > 0.99 * 2048 * (got.sequence_id.nunique() - 1)


def test_patterns_place_everything():
    r = random.Random(2)
    counts = {n: r.randint(1, 500) for n in range(1, 257) if r.random() < 0.6}
    made: Counter = Counter()
    used = 0
    for packs, pattern in packing.shortest_pack_first(counts, 256):
        assert sum(n * k for n, k in pattern) <= 256
        used += packs
        for n, k in pattern:
            made[n] += packs * k
    least = max(-(-sum(n * k for n, k in counts.items()) // 256), sum(k for n, k in counts.items() if n > 128))
    assert made == counts and used <= 1.02 * least


def test_jaccard(docs, empty):
    everything = jaccard.near_duplicates(docs).collect()
    got = {r["doc_id"]: tuple(r) for r in everything if r["doc_id"] is not None}
    want = {w[0]: w for w in jaccard.plain_components(known())}
    assert got == want and len(everything) == len(corpus())
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(k for k, n, c in want.values() if k == c)
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one_of_each(empty).count() == 0


def test_one_of_each_is_judged_by_id_and_text(spark):
    """One id on unrelated texts, on near copies and on repeats; null ids alone, among themselves and beside others."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (6, b), (6, b + " more"), (7, c), (7, c), (8, ""), (8, None), (8, ""), (None, a + " more"), (None, d), (None, d + " more"), (9, "one two")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _k1 int, chosen string")
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), (r["text"] or "")[:2]) for r in kept.collect())
    assert got == [(-1, "d0"), (5, "a0"), (5, "b0"), (7, "c0"), (8, ""), (8, ""), (8, ""), (9, "on")]


def test_jaccard_on_groups_without_a_hub(spark):
    """Chains in which only neighbours link, families of a base, and boundaries of the bound itself."""
    words = [f"w{i}" for i in range(3000)]
    chain = [" ".join(words[4 * k : 4 * k + 60]) for k in range(40)]
    family = [" ".join(words[500:640])] + [" ".join([*words[500:520], f"x{k}", *words[521:560], f"y{k % 3}", *words[561:640]]) for k in range(30)]
    family += [" ".join([*words[500:530], *[f"z{k}-{j}" for j in range(25)], *words[555:640]]) for k in range(10)]
    edge = [" ".join(words[1000:1100]), " ".join([*words[1000:1087], *[f"e{i}" for i in range(13)]]), " ".join([*words[1000:1086], *[f"f{i}" for i in range(14)]])]
    docs = list(enumerate([*chain, *family, *edge]))
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(jaccard.plain_components(docs))


def test_repeats(docs, empty):
    full = [(i, t) for i, t, *_ in corpus()]
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, sink="digest").collect()))
    assert got == sorted((-1 if w[0] is None else w[0], *w[1:]) for w in repeats.plain_repeats(full))
    small = repeats.remove_repeats(docs, window=6, rounds=2, sink="digest").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in small) == sorted((-1 if w[0] is None else w[0], *w[1:]) for w in repeats.plain_repeats(full, 6))
    assert repeats.remove_repeats(empty).count() == 0


def test_windows_are_compared_by_their_words(monkeypatch):
    """Windows under hashes that mostly collide fall into the classes of their words."""
    r = random.Random(3)
    runs = [" ".join(r.choice("ab") + "é" * r.randrange(2) for _ in range(r.randrange(4, 12))).encode() for _ in range(60)]
    n = np.array([len(x.split()) - 3 for x in runs])
    want = [b" ".join(x.split()[k : k + 4]) for x in runs for k in range(len(x.split()) - 3)]
    for poor in (False, True):
        if poor:
            plain = wordscan.rolled
            monkeypatch.setattr(repeats, "rolled", lambda h, size: plain(h, size) % np.uint64(3))
        got = repeats._equal_windows(runs, n, 4).tolist()
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_common_names_are_dealt_by_their_windows(spark, monkeypatch):
    """One line in every document: no block gets more than a fair part of the windows around it, and results stay."""
    r = random.Random(6)
    line = " ".join(f"c{k}" for k in range(20))
    docs = [(i, " ".join([*(f"u{r.randrange(30)}" for _ in range(25)), line, *(f"v{r.randrange(30)}" for _ in range(25))])) for i in range(250)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted(repeats.plain_repeats(docs, 12))
    rows = df.select(F.col("text").alias("_text"), F.xxhash64("doc_id").alias("ka"), F.hash("doc_id").alias("kb"))
    largest = {}
    for common in (10**9, 50):
        monkeypatch.setattr(repeats, "COMMON", common)
        table, hot = (spark.sparkContext.broadcast(x) for x in repeats.repeated_names(rows, 10**5, 12, 2))
        blocks = repeats._window_blocks(rows, table, hot, 64, 12, 2).select("block", "n").collect()
        sizes = Counter()
        for x in blocks:
            sizes[x["block"]] += int(np.frombuffer(x["n"], "<u4").sum())
        largest[common] = max(sizes.values()) / sum(sizes.values())
        assert sorted(map(tuple, repeats.remove_repeats(df, window=12, rounds=2, sink="digest").collect())) == want
    assert largest[50] < largest[10**9]


def test_symbols_depend_on_their_range_alone():
    """A symbol is found again wherever the words of its range are, whatever surrounds them."""
    r = random.Random(8)
    text = [w for _ in range(150) for w in [f"t{r.randrange(50)}"] * r.choice((1, 1, 1, 2, 5))]
    compared = 0
    for trial in range(60):
        around = [r.choice([f"o{r.randrange(9)}", *text[:3]]) for _ in range(40)]
        cut, n = r.randrange(len(text) - 100), r.randrange(40, 100)
        if trial % 2:
            around[19] = text[cut]  # a run may go on beyond the passage
        other = around[:20] + text[cut : cut + n] + around[20:]
        (a,), (b,) = (list(wordscan.scan(pa.array([" ".join(t)]), wordscan.PLAIN_WORDS)) for t in (text, other))
        name, low, high = repeats.recompress(a, 5)
        found = set(zip(*(x.tolist() for x in repeats.recompress(b, 5))))
        inside = (low >= cut) & (high <= cut + n)
        compared += int(inside.sum())
        for k in np.flatnonzero(inside):
            assert (name[k], low[k] - cut + 20, high[k] - cut + 20) in found
    assert compared > 200


def test_scores(spark, docs, empty):
    unique = {i: t for i, t in known()}
    df = spark.createDataFrame(list(unique.items()), "doc_id long, text string").repartition(3)
    wanted = {i for i in unique if i % 2}
    got = lmscore.score(df, spark.createDataFrame([(i,) for i in [*wanted, 1, 12345]] + [(None,)], "doc_id long")).collect()
    want = lmscore.plain_scores(list(unique.items()), wanted)
    assert len(got) == len(unique)
    for r in got:
        n, t, b = want[r["doc_id"]]
        assert r["n_tokens"] == n
        if n:
            assert abs(r["target_loss"] - t) < 1e-9 and abs(r["background_loss"] - b) < 1e-9 and abs(r["score"] - (t - b)) < 1e-9
        else:
            assert r["score"] is None
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.score(docs, none).count() == len(corpus()) and lmscore.score(empty, none).count() == 0


def test_scores_where_one_bigram_is_everywhere(spark, monkeypatch):
    """A bigram of every document, small batches and many blocks: a block gets an entry for each batch, not for each document."""
    monkeypatch.setattr(lmscore, "BATCH", 400)
    monkeypatch.setattr(lmscore, "BLOCK", 50)
    r = random.Random(9)
    docs = [(i, "common words " * r.randrange(1, 4) + " ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(30)))) for i in range(400)] + [(1000, ""), (1001, None)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, ka int, batch int").coalesce(1)
    wanted = set(range(0, 400, 3))
    want = lmscore.plain_scores(docs, wanted)
    rows = df.select(F.col("text").alias("_text"), F.xxhash64("doc_id").alias("ka"), F.hash("doc_id").alias("kb"), (F.col("doc_id") % 3 == 0).alias("_target"))
    asked = lmscore._asked(rows, 64).where("place >= 0").collect()
    batches = {x["batch"] for x in asked}
    told = Counter()
    for x in asked:
        told[x["place"]] += len(lmscore._unpacked(x["names"]))
    assert max(told.values()) < sum(told.values()) / 16 and len(batches) < 40
    for x in lmscore.score(df, spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect():
        n, t, b = want[x["doc_id"]]
        assert x["n_tokens"] == n and (not n or abs(x["target_loss"] - t) < 1e-9 and abs(x["background_loss"] - b) < 1e-9)


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "Some project\n  Released under the MIT License.\n"), (2, "a/b/c.txt", "nothing here"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/d/e.txt", None), (5, "x/y.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "x/z.txt", ""), (7, None, "All rights reserved."),
        (8, "a/b2/f.txt", "the license of this file is under no terms of any kind that we would know"), (2, "a/b/c.txt", "nothing here"),
    ]
    df = spark.createDataFrame([(*f, 1) for f in files], "id long, at string, text string, folder int")
    got = licenses.scan_licenses(df, "id", F.col("at")).collect()
    assert len(got) == len(files)
    by = {r["id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in got}
    assert by == {
        1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "a/b"), 5: ("GPL-3.0", "GPL-3.0", None), 6: (None, None, None),
        7: ("Proprietary", "Proprietary", None), 8: (None, "MIT", "a"),
    }
    assert {r["own_score"] for r in got if r["id"] in (1, 3, 5, 7)} == {1.0}
    assert licenses.scan_licenses(df.where("false"), "id", F.col("at")).count() == 0


#: Statements as documents and sources carry them, and near misses.
STATEMENTS = [
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("All rights reserved.", "Proprietary"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-NC-ND 3.0", "CC-BY-NC-ND-3.0"), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("# SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("SPDX-License-Identifier: AGPL-3.0", "AGPL-3.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("Licensed under the BSD 2-Clause License", "BSD-2-Clause"), ("Released under the ISC License", "ISC"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Released under the Foo License.", None), ("Licensed under the Foo License.", None), ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("mit", None), ("Apache", None), ("isc", None), ("Licensed under the MIT License", "MIT"), ("Licensed under the ISC License", "ISC"), ("he was licensed under the 4.0 rule by nc", None),
]


def test_licence_statements(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STATEMENTS)], "id long, text string")
    got = {r["id"]: r["own_license"] for r in licenses.scan_licenses(df, "id", F.format_string("d%s/f", "id")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(STATEMENTS)] == STATEMENTS


#: Wrapped headers, embedded statements, and prose that is none.
HEADERS = [
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os\n", "GPL-3.0"),
    ("/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Affero General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */", "AGPL-3.0"),
    ("// Licensed under the Apache\n// License, Version 2.0 (the \"License\");\n// you may not use this file\n// except in compliance with the License.\n", "Apache-2.0"),
    ("Copyright 2019 Example Corporation. All rights reserved.", "Proprietary"), ("The parser was written in 2019. Released under the MIT License. Patches are welcome and so are reports of mistakes.", "MIT"),
    ("this small library for reading old tables was released under the MIT License by its two authors many years ago", "MIT"), ("The photographs of this long article\nare licensed under CC BY-NC 4.0, where\nnothing else is said about them", "CC-BY-NC-4.0"),
    ("They reserved all seats, and had the rights to use the version of this work with or without the license of the public office, as the terms are free", None), ("Er kam mit dem Zug und fuhr mit dem Bus. Sie ging mit ihm unter die Leute", None),
]


def test_licence_headers_and_embedded_statements(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADERS)], "id long, text string")
    got = {r["id"]: r["own_license"] for r in licenses.scan_licenses(df, "id", F.format_string("d%s/f", "id")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(HEADERS)] == HEADERS


def test_first_look_loses_none():
    """A text without any of the telling terms is no statement or stays below the threshold, whatever else of a template it holds."""
    w = licenses.Weights(licenses.TEMPLATES)
    telling = set(w.telling(licenses.THRESHOLD))
    for v in w.vectors:
        rest = {t: x for t, x in v.items() if t not in telling}
        assert len(rest) < 2 or not rest.keys() - licenses.PROSE or sum(x * x for x in rest.values()) < licenses.THRESHOLD**2


def test_licences_among_hot_folders_odd_names_and_levels(spark):
    """Clashing column names, one folder that holds most files, several licence files in it, levels without any."""
    rows = [(k, f"a/b/f{k}.txt", "words", 1, "x") for k in range(300)]
    rows += [(1000, "a/b/LICENSE.2", "Licensed under CC BY 4.0", 1, "x"), (1001, "a/b/LICENSE.1", "Released under the ISC License", 1, "x"), (1002, "COPYING", "All rights reserved", 1, "x"), (1003, "z/y/x/w", "", 1, "x"), (1004, "a/LICENSE", "nothing that is known", 1, "x"), (1005, "a/c", "x " * 200_000, 1, "x")]
    df = spark.createDataFrame(rows, "line long, at string, text string, template int, terms string")
    got = {r["line"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan_licenses(df, "line", F.col("at")).collect()}
    assert all(got[k] == (None, "ISC", "a/b") for k in range(300))
    assert got[1000][0] == "CC-BY-4.0" and got[1002] == ("Proprietary", "Proprietary", None) and got[1003] == (None, "Proprietary", "") and got[1004] == (None, "Proprietary", "") and got[1005] == (None, "Proprietary", "")


def test_exact(docs, empty):
    got = exact.exact_dedup(docs).collect()
    rows = [(i, " ".join(x for x in _split(t))) for i, t, *_ in corpus()]
    members: dict = {}
    for i, t in rows:
        members.setdefault(t, []).append(i)
    want = sorted((str(i), str(min((m for m in members[t] if m is not None), default=None)), len(members[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert exact.exact_dedup(empty).count() == 0 and exact.drop_exact_duplicates(empty).count() == 0


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    """Words and their opposites, which collide under any polynomial hash modulo a power of two."""
    a, b = [f"{thue_morse(n, x)}{k}" for k in range(35) for x in ("ab",)], [f"{thue_morse(n, 'ba')}{k}" for k in range(35)]
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, a[0][:n]), (4, b[0][:n]), (5, "x" * n + "ab"), (6, "x" * n + "ba")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == sorted(jaccard.plain_components(docs))
    assert sorted(map(tuple, repeats.remove_repeats(df, sink="digest").collect())) == sorted(repeats.plain_repeats(docs))
    got = decontaminate.contamination(df, spark.createDataFrame([(7, " ".join(a)), (8, b[0][:n])], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_hit"], r["items"], r["longest_match"]) for r in got} == {1: (35, ["7"], 35), 2: (0, [], 0), 3: (0, [], 0), 4: (1, ["8"], 1), 5: (0, [], 0), 6: (0, [], 0)}


def test_decontamination_compares_words(monkeypatch):
    """Hashes that collide on purpose: in the benchmark another family is taken, in the texts bytes decide."""
    plain = wordscan.spelled

    def poor(data, starts, ends, seed=0):
        return plain(data, starts, ends, seed) % np.uint64(3) if seed < 2 else plain(data, starts, ends, seed) % np.uint64(40)

    monkeypatch.setattr(wordscan, "spelled", poor)
    items, texts = ["a b c d", "e f", "g"], ["a b c d e f g", "a b c e", "x f", "q r s t u v w x y z g a b c d"]
    q = decontaminate.build_queries(list(zip("123", items)), 3)
    assert q.seed >= 2 and len(q.vocabulary) == 7
    got = decontaminate._mark(pa.array(texts), None, q).to_pylist()
    want = decontaminate.plain_contamination(list(enumerate(texts)), list(zip("123", items)), 3)
    assert [(m["_n"], 0 if m["_hit"] is None else sum(bin(x).count("1") for x in m["_hit"]), len(m["_items"])) for m in got] == [w[1:4] for w in want]
    assert [m["_longest"] for m in got] == [4, 3, 0, 4]


def _split(text: str | None) -> list[str]:
    import re

    return re.split(r"[\x20\x09-\x0D]+", text or "")


def test_decontamination(spark, docs, empty):
    items = [(i, " ".join((dict(known())[k] or "").split()[a:b])) for i, (k, a, b) in enumerate([(0, 5, 40), (20, 30, 70), (34, 0, 1), (30, 0, 3), (41, 100, 112)])] + [(90, None), (91, "..."), (0, "not anywhere at all but long enough to be a window of ten words"), (None, "nobody KNOWS")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.plain_contamination([(i, t) for i, t, *_ in corpus()], [("" if i is None else i, t) for i, t in items])))
    for block in (decontaminate.BLOCK_WORDS, 20):
        got = decontaminate.contamination(docs, bench, block_words=block).collect()
        assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"])) for r in got) == want
        clean = decontaminate.drop_contaminated(docs, bench, block_words=block)
        assert clean.columns == docs.columns and clean.count() == sum(w.endswith("False)") for w in want)
    longest = decontaminate.longest_matches(docs, bench).where("doc_id = 0 and item_id = '0'").collect()
    assert [tuple(r)[2:] for r in longest if r["n_words"] > 20] == [(0, 5, 35)] * 2  # document 0 is told twice
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.longest_matches(docs, bench.where("false")).count() == 0
