import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from . import brute

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", StringType()), StructField("fp", StringType()), StructField("id", StringType())])


def corpus(seed=1, n=70):
    """Nulls, empties, copies, near copies, shared passages, one long text, repeated rows; clashing column names."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = say(30)
    texts = [None, "", " \n ", "one", "one two", "One TWO three"] + [say(rng.randint(5, 120)) for _ in range(n)]
    texts += [texts[10]] * 4 + [texts[11] + " tail", passage, say(9) + passage + say(3), passage.upper() + "\n" + say(2), say(3000), "a" * 700, "a" * 600, "mail a.b@c.de or +1 (988) 555-2485, 4337166598464399 10.0.0.1"]
    words = texts[12].split()
    words[len(words) // 2] = "changed"
    texts.append(" ".join(words))
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], (None, passage), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "y", "z") for d, t in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


def test_suffix_dedup(spark, rows):
    from quarryline.llm import suffix_dedup

    assert collected(suffix_dedup.report(frame(spark, rows))) == ordered(brute.repeats(rows))
    assert suffix_dedup.report(frame(spark, [])).count() == 0
    texts = suffix_dedup.remove_repeats(frame(spark, rows), texts=True).select("kept_sha256", F.sha2("kept", 256).alias("h"))
    assert texts.where("kept_sha256 <> h").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_on_few_letters(spark, seed):
    from quarryline.llm import suffix_dedup

    rng = random.Random(seed)
    docs = [(k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) * rng.randint(1, 4)) for k in range(60)]
    assert collected(suffix_dedup.report(frame(spark, docs))) == ordered(brute.repeats(docs))


def test_lm_score(spark, rows):
    from quarryline.llm import lm_score

    got, want = collected(lm_score.report(frame(spark, rows)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")), ordered(brute.base_scores(rows))
    assert [(r[0], r[1], r[2]) for r in got] == [(r[0], r[1], r[2]) for r in want]
    key = lambda r: (repr(r[:5]), round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    assert lm_score.report(frame(spark, [])).count() == 0


def test_lm_filter_never_loses_a_count():
    from quarryline.llm.lm_score import _MEANS, Filter, level

    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    c = rng.zipf(1.5, 5000).clip(1, 10**7)
    f = Filter({0: Filter.field(h, c, 1 << 19)}, 1)
    assert (f.levels(h) >= level(c)).all() and (f.levels(h) == level(c)).mean() > 0.97
    assert (f.levels(rng.integers(0, 2**63, 5000, dtype=np.uint64)) > 0).mean() < 0.03
    assert abs(np.log(_MEANS[level(c)] / c)).max() < np.log(1.5)


def test_pii(spark, rows):
    from quarryline.llm import pii

    rng = random.Random(9)
    odd = [(1000 + k, "".join(rng.choice("a1@.-+ (2)5b,\n19é") for _ in range(rng.randint(0, 60)))) for k in range(800)]
    docs = rows + odd
    got = collected(pii.report(frame(spark, docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"))
    shown = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    want = ordered((d, *(sum(x[0] == k for x in s) for k in ("email", "ip", "card", "phone")), hashlib.sha256(shown(s).encode()).hexdigest(), shown(s)) for d, t in docs for s in [brute.personal(t or "")])
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert all(g[6].startswith(w[6]) for g, w in zip(got, want, strict=True))


def test_pii_further_kinds_and_redaction(spark):
    from quarryline.llm import pii

    text = "iban DE89370400440532013000, not DE88370400440532013000; call (212) 555-0199;" + " nothing near names the kind of what comes here:" * 2 + " 212 555 0199" + " and nothing after it does either, not for a while" * 2 + "; ssn 078-05-1120"
    _, more = pii.find_spans(text)
    assert [x.kind for x in more] == ["iban", "phone_national", "ssn"]
    out = pii.redact(frame(spark, [(1, "write a@b.co now"), (2, None), (3, "")])).select("doc_id", "text").collect()
    assert dict(map(tuple, out)) == {1: "write [EMAIL] now", 2: None, 3: ""}
    assert pii.find_spans("1" * 200_000 + "." * 1000 + "a" * 200_000 + "@" + "-" * 100_000)[0] == []


def test_simhash(spark, rows):
    from quarryline.llm import simhash

    fp = [brute.fingerprint(t) for _, t in rows]
    root = brute.groups(len(rows), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root[k]] = min(least.get(root[k], d), d)
    want = ordered((d, f"{fp[k]:016x}", least.get(root[k])) for k, (d, _) in enumerate(rows))
    assert collected(simhash.report(frame(spark, rows)).select("doc_id", "fingerprint", "component_id")) == want
    assert simhash.report(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 6, 7])
def test_simhash_tables_cover_the_radius(radius):
    from quarryline.llm.simhash import masks

    rng = random.Random(radius)
    tables = masks(radius)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), radius):
            y ^= 1 << k
        assert any(x & m == y & m for m in tables)


def test_simhash_links_in_heavy_groups():
    from quarryline.llm.simhash import links_of

    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 63, (60, 2), dtype=np.uint64)).sum(1).astype(np.uint64) for c in centre]))
    group, near = np.zeros(len(fp), np.int64), np.zeros(len(fp), np.uint64)
    pairs = [p for a, b in links_of(group, fp, near, 3, 64, heavy=50) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 3 for a, b in pairs)
    linked = {frozenset(p) for p in pairs}
    assert brute.groups(len(fp), lambda a, b: frozenset((a, b)) in linked) == brute.groups(len(fp), lambda a, b: (int(fp[a]) ^ int(fp[b])).bit_count() <= 3)


def test_components_on_a_chain(spark):
    from quarryline.llm.simhash import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert dict(map(tuple, components(edges).collect())) == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_keep_first(spark):
    from quarryline.llm import simhash

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    near = list(base)
    near[150] = "other"
    other = [f"v{rng.randint(0, 5000)}" for _ in range(300)]
    docs = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(other)), (9, " ".join(other)), (None, " ".join(base)), (11, None), (12, "")]
    kept = sorted(map(tuple, simhash.keep_first(frame(spark, docs)).select("doc_id").collect()))
    assert kept == [(3,), (9,), (11,)]
    assert simhash.keep_first(frame(spark, docs)).columns == DOC.names


def labelled(spark):
    rng = random.Random(2)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "house", "green", "stands", "here", "often"]) + rng.choice("abcdef") for _ in range(8)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join("X%$#" + rng.choice("!@&") for _ in range(8)) for _ in range(4))
    docs = [(k, good() if k % 3 else bad()) for k in range(150)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)] + [(3, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(spark):
    from quarryline.llm import quality

    docs, labels = labelled(spark)
    rows = quality.report(frame(spark, docs), labels).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 150]
    assert len(held) > 15 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    kept = {r["doc_id"] for r in quality.keep_good(frame(spark, docs), labels).collect()}
    assert all(k in kept for k in range(150) if k % 3)
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality.report(frame(spark, docs[:4]), none).collect()} == {0.5}
    assert quality.report(frame(spark, []), labels).count() == 0


def test_quality_marginals_match_enumeration():
    import itertools

    from quarryline.llm.quality import N_ALL, Field

    rng = np.random.default_rng(1)
    f = Field(rng.normal(size=N_ALL), rng.normal(size=(2, 2)))
    x = rng.normal(size=(5, N_ALL)) / 5
    e = np.stack([np.zeros(5), x @ f.weights], 1)
    paths = list(itertools.product((0, 1), repeat=5))
    w = np.exp([sum(e[t, p[t]] for t in range(5)) + sum(f.pair[p[t], p[t + 1]] for t in range(4)) for p in paths])
    want = [sum(a for a, p in zip(w, paths, strict=True) if p[t]) / w.sum() for t in range(5)]
    assert np.allclose(f.marginals(x, np.array([0, 5])), want)


def test_top_k(spark):
    from quarryline.llm import topk

    rng = np.random.default_rng(7)
    vec = np.round(rng.normal(size=(400, 12)) * rng.lognormal(size=(400, 1)), 1)
    vec[50:80] = vec[40]
    rows = [(k, v.tolist()) for k, v in enumerate(vec)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (None, [1.0]), (904, []), (905, [3.0, -2.0]), (33, vec[33].tolist())]
    df = spark.createDataFrame(rows, StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType()))]))
    good = [(i, np.floor(64 * np.array([*v, *[0.0] * (12 - len(v))])).astype(int)) for i, v in rows if i is not None and v is not None and i not in (901, 902, 903)]
    want = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.report(df).collect())) == sorted(want)
    assert sorted(map(tuple, topk.top_k(df, query_block=7).collect())) == sorted(want)
    assert topk.report(df.where("vec_id < 0")).count() == 0


def test_decontamination(spark, rows):
    from quarryline.llm import decontaminate

    by_id = {d: t for d, t in rows if d is not None}
    long = max((t for t in by_id.values() if t), key=len).split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[120:140])), (3, "one two"), (4, None), (5, " , "), (1, " ".join(long[100:130])), (None, " ".join(long[500:520])), (10, by_id[15])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = ordered((d, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2) for d, n, hit, ids in brute.overlaps(rows, items))
    df = frame(spark, rows)
    assert collected(decontaminate.report(df, bench)) == want
    blocks = decontaminate.find_overlaps(df, bench, block_bytes=200).select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"))
    assert collected(blocks) == [r[:4] for r in want]
    assert decontaminate.report(df, bench.where("false")).where("n_items > 0").count() == 0
    assert decontaminate.report(frame(spark, []), bench).count() == 0
    clean = decontaminate.remove_overlaps(df, bench)
    assert clean.columns == DOC.names and clean.count() == len(rows)
    assert decontaminate.report(clean.where("text like '%changed%' or doc_id = 15"), bench).where("n_items > 2").count() == 0


def test_fm_index_finds_every_occurrence():
    from quarryline.llm.decontaminate import FMIndex, ranges

    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 600)
    index = FMIndex(text, 5)
    patterns = np.array([text[k : k + 4] for k in range(0, 500, 7)] + [[4, 4, 4, 4]])
    alive, low, high = index.search(patterns, np.full(len(patterns), 4))
    suffix, of = ranges(low, high)
    got = {}
    for p, at in zip(alive[of], index.locate(suffix), strict=True):
        got.setdefault(int(p), set()).add(int(at))
    for k, p in enumerate(patterns):
        assert got.get(k, set()) == {a for a in range(597) if (text[a : a + 4] == p).all()}


needs_model = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no vocabulary file")


def odd_texts():
    rng = random.Random(6)
    texts = ["", "  a  b\n\n\tc  ", "日本語テキスト é ﬁ \U0001f600 x", "aaaaaaaaaaaaaaaaaaa bbbbbbbbb", "    \n   \n", "it's, (he said): \"well...\" $12.50%", "x" * 3000]
    return texts + ["".join(rng.choice("abehinrst e  .,|\nöé日 ") for _ in range(rng.randint(1, 200))) for _ in range(300)]


@needs_model
def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    from quarryline.llm import sentencepiece_fst
    from quarryline.llm.vocabulary import Pieces, default_model

    machine, library = sentencepiece_fst.Transducer(Pieces.load()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    for t in [*odd_texts(), "▁▁x y", "<s> </s> <0x0A>"]:
        assert machine.encode(t).tolist() == library.encode(t)
        assert machine.decode(library.encode(t)) == library.decode(library.encode(t))
    docs = [(k, t) for k, t in enumerate(odd_texts())] + [(None, None)]
    df = frame(spark, docs)
    assert sentencepiece_fst.report(df).where("not round_trip").count() == 0
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(df).drop("text"))
    assert collected(back.select("doc_id", "text")) == ordered((d, t or "") for d, t in docs)


@needs_model
def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quarryline.llm import token_counts
    from quarryline.llm.vocabulary import Pieces

    scores = token_counts.unigram_scores(Pieces.load())
    least = min(scores.values())
    library = Tokenizer(models.Unigram([("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256)), *scores.items()], unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    docs = [(k, t) for k, t in enumerate(odd_texts())] + [(None, None)]
    got = token_counts.count_tokens(frame(spark, docs).select("doc_id", "text"))
    want = ordered((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in docs)
    assert collected(got.select("doc_id", "n_tokens")) == want


def test_tool_chat_links_orders_and_validates(spark):
    from quarryline.llm import tool_chat
    from quarryline.llm.tool_chat import Parameter, Tool

    call = lambda i, name, args, after="[]": f'<tool_call>{{"id":"{i}","name":"{name}","arguments":{args},"after":{after}}}</tool_call>'
    rows = [
        (1, 1, "assistant", "first " + call("b", "search", '{"q": "x", "n": 2}', '["a"]')),
        (1, 2, "assistant", call("a", "search", '{"n": "two", "q": "y"}') + call("c", "none", "{}")),
        (1, 3, "tool", '{"tool_call_id": "a", "content": "r"}'),
        (1, 4, "tool", '{"tool_call_id": "zzz"}'),
        (2, 1, "assistant", call("p", "search", '{"q": "x"}', '["q"]')),
        (2, 2, "assistant", call("q", "search", '{"q": 1, "z": true}', '["p"]')),
        (3, 1, "user", "hi"), (3, 2, "assistant", "ho"), (3, 2, "assistant", "ho"), (3, 3, "user", ""), (None, 1, "user", None), (4, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    tools = (*tool_chat.PLAIN, Tool("search", {"q": Parameter("string", True, 1), "n": Parameter("integer", False)}))
    got = tool_chat.format_chat(df, tools).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert (by[1, 1]["at_turn"], by[1, 1]["level"]) == (2, 1) and (by[1, 2]["at_turn"], by[1, 2]["level"]) == (2, 0)
    assert by[1, 2]["n_invalid"] == 2 and by[1, 2]["n_unanswered"] == 1 and by[1, 3]["linked"] and not by[1, 4]["linked"]
    assert '"arguments":{"n":2,"q":"x"}' in by[1, 1]["json"] and by[1, 1]["json"].startswith('{"calls":[')
    assert by[2, 1]["cyclic"] and by[2, 2]["cyclic"] and by[2, 2]["n_invalid"] == 1
    assert by[3, 2]["linked"] and by[3, 1]["n_unanswered"] == 0 and by[3, 3]["n_invalid"] == 1 and by[3, 3]["n_unanswered"] == 1
    assert tool_chat.format_chat(df.where("false"), tools).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    secret = docs[1][1] + " write to a.b@c.de"
    docs = [*docs, (700, docs[1][1]), (701, secret), (702, docs[2][1] + " " + docs[4][1])]
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    passage = docs[7][1]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, str(tmp_path)).columns == read.columns, name
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(k % 3 == 0 for k in out if k < 150) and 700 not in out
    assert 7 not in out or brute.overlaps([(7, out[7]["text"])], [(1, passage)])[0][2] == set()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out.values())
    assert not any("a.b@c.de" in (r["text"] or "") for r in out.values())


def test_lm_score_does_not_depend_on_the_bytes_of_a_broadcast(spark, rows):
    from quarryline.llm import lm_score

    df = frame(spark, rows)
    whole = {r["doc_id"]: r["score"] for r in lm_score.score(df).collect()}
    ranges = {r["doc_id"]: r["score"] for r in lm_score.score(df, filter_mb=0.0005).collect()}
    assert ranges == pytest.approx(whole, rel=1e-12)


def test_lm_filter_holds_bigrams_counted_once(spark):
    from quarryline.llm import lm_score

    docs = frame(spark, [(k, f"left{k} right{k}") for k in range(40)])
    training = docs.where(~lm_score.held_out())
    blocks = lm_score.gather(training, "text", 3).where("kind = 2").collect()
    filt = lm_score.Filter({r["bucket"]: np.frombuffer(r["bits"], np.uint8) for r in blocks}, 3)
    for r in training.collect():
        t, _ = lm_score.tokens(np.frombuffer(r["text"].encode(), np.uint8), np.array([0, len(r["text"])]))
        assert (filt.levels(lm_score.bigrams(t)) >= 1).all()


@pytest.mark.parametrize("often", [2, 3])
def test_keep_first_goes_by_the_similarity_of_five_word_shingles(spark, often, monkeypatch):
    from quarryline.llm import simhash

    monkeypatch.setattr(simhash, "OFTEN", often)
    monkeypatch.setattr(simhash, "TOGETHER", 10)
    rng = random.Random(8)
    line = " ".join(f"c{k}" for k in range(14))
    docs = []
    for k in range(60):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 150))] + (line.split() if k % 2 else [])
        docs.append(" ".join(base))
        for edits in (1, 2, 3, 5):
            other = list(base)
            for j in rng.sample(range(len(base)), min(edits, len(base))):
                other[j] = f"x{rng.randint(0, 3000)}"
            docs.append(" ".join(other).upper())
    sets = []
    for t in docs:
        w = t.lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    root = brute.groups(len(docs), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    least = {}
    for k in range(len(docs)):
        least.setdefault(root[k], k)
    kept = sorted(r["doc_id"] for r in simhash.keep_first(frame(spark, list(enumerate(docs)))).select("doc_id").collect())
    assert 60 < len(kept) < len(docs) and kept == sorted(least.values())


@pytest.mark.parametrize("part", ["tables", "rest", "dealt"])
def test_keep_first_gets_candidates_from_the_covering_tables(spark, part, monkeypatch):
    from quarryline.llm import simhash

    rng = random.Random(9)
    docs = [(900, None), (901, " ")]
    for k in range(25):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 200))]
        for edits in (0, 1, 2, 3):
            other = list(base)
            for j in rng.sample(range(len(base)), edits):
                other[j] = f"x{rng.randint(0, 3000)}"
            docs.append((len(docs), " ".join(other)))
    want = brute.keep_first(docs)
    if part == "tables":  # without the search for the rest: what the fingerprints connect, compared
        real = simhash.sharing
        monkeypatch.setattr(simhash, "sharing", lambda *a: real(*a).where("grp IS NULL"))
        prints = [(brute.fingerprint(t, 1, True), brute.fingerprint(t, 5, True)) for _, t in docs]
        met = brute.groups(len(docs), lambda a, b: (prints[a][0] ^ prints[b][0]).bit_count() <= simhash.MEET and (prints[a][1] ^ prints[b][1]).bit_count() <= simhash.APART)
        want = sorted(d for root in set(met) for d in brute.keep_first([x for x, r in zip(docs, met, strict=True) if r == root]))
        assert len(want) < len(docs) - 40
    elif part == "rest":  # without the tables
        monkeypatch.setattr(simhash, "links", lambda nodes, **_: spark.createDataFrame([], "a long, b long"))
    else:  # groups of more than four are dealt by hash
        docs += [(len(docs) + k, docs[2][1] + f" y{k}") for k in range(20)]
        want = brute.keep_first(docs)
        monkeypatch.setattr(simhash, "TOGETHER", 2)
    kept = sorted(r["doc_id"] for r in simhash.keep_first(frame(spark, docs)).select("doc_id").collect())
    assert kept == want


def test_pii_is_linear_in_the_spans_of_a_text():
    import time

    from quarryline.llm import pii

    text = "4111111111111111; account GB82WEST12345698765432; " * 20_000
    began = time.time()
    base, more = pii.find_spans(text)
    assert len(base) == 20_000 and len(more) == 20_000 and time.time() - began < 20


def test_decontamination_keeps_documents_of_one_id_apart(spark):
    from quarryline.llm import decontaminate

    a, b = (" ".join(f"{x}{k}" for k in range(8)) for x in "ab")
    docs, items = frame(spark, [(1, a), (1, b), (1, a), (None, b)]), spark.createDataFrame([(10, a), (20, b), (20, b)], "item_id long, text string")
    got = [collected(decontaminate.find_overlaps(docs, items, block_bytes=size).select("doc_id", "n_hit", F.array_join("item_ids", ","), F.size("hits"))) for size in (1 << 20, 30)]
    assert got[0] == got[1] == [(None, 8, "20", 1), (1, 8, "10", 1), (1, 8, "10", 1), (1, 8, "20", 1)]


def test_top_k_of_repeated_queries(spark):
    from quarryline.llm import topk

    rng = np.random.default_rng(11)
    vec = rng.normal(size=(60, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(vec)] + [(20, vec[20].tolist()), (40, vec[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.report(df).collect()
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for i, q in [(0, whole[0][1]), (20, whole[20][1]), (40, whole[40][1]), (40, whole[61][1])]:
        best = sorted((-int(q @ v), j) for j, v in whole if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_prunes_pairs_by_partial_sums():
    from quarryline.llm.topk import Ranked, Search

    rng = np.random.default_rng(12)
    v = np.floor(64 * rng.normal(size=(3000, 16)) * np.linspace(2, 0.1, 16)).astype(np.int64)
    rotation = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1].copy()
    search, best = Search(np.arange(50), v[:50], rotation, 5), Ranked(np.full(50, -np.inf), 5)
    order = np.argsort(-(v * v).sum(1))
    for a in range(0, 3000, 500):
        search.scan(order[a : a + 500], v[order[a : a + 500]], best)
    q, i, s = best.fold()
    for k in range(50):
        assert sorted(s[q == k].tolist()) == sorted(np.delete(v @ v[k], k).tolist())[-5:]
    assert search.left[2] < search.seen / 4


def test_tool_chat_orders_chains_like_a_plain_relaxation(spark):
    import json

    from quarryline.llm import tool_chat

    rng = random.Random(3)
    rows, waits, turn_of = [], {}, {}
    for conv in range(6):
        n = 12
        turns = rng.sample(range(1, 50), n)
        for k in range(n):
            after = [f"c{j}" for j in range(n) if j != k and rng.random() < 0.12] + ["gone"] * (k % 2)
            rows.append((conv, turns[k], "assistant", "<tool_call>" + json.dumps({"id": f"c{k}", "name": "reply", "arguments": {"prompt": "p"}, "after": after}) + "</tool_call>"))
            waits[conv, f"c{k}"], turn_of[conv, f"c{k}"] = [a for a in after if a != "gone"], turns[k]
    place = {}
    while True:
        new = {}
        for (conv, c), on in waits.items():
            if (conv, c) not in place and all((conv, a) in place for a in on):
                t, level = max((place[conv, a] for a in on), default=(-1, -1))
                new[conv, c] = (t, level + 1) if t >= turn_of[conv, c] and level >= 0 else (turn_of[conv, c], 0)
        if not new:
            break
        place |= new
    got = tool_chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert 0 < sum(r["cyclic"] for r in got) < len(rows)
    for r in got:
        c = (r["conv_id"], json.loads(r["json"])["calls"][0]["id"])
        assert r["cyclic"] == (c not in place)
        assert (r["at_turn"], r["level"]) == place.get(c, (turn_of[c], 0))


def test_tool_chat_joins_by_hash(spark):
    from quarryline.llm import tool_chat

    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "ho")]
    plan = tool_chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("seed", [5, 16, 50])
def test_textbook_doubling_gives_the_same_repeats(spark, rows, seed):
    from quarryline.llm import suffix_dedup

    rng = random.Random(seed)
    few = [(100 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) * rng.randint(1, 4)) for k in range(40)]
    docs = rows + few
    assert collected(suffix_dedup.remove_repeats(frame(spark, docs), seed=seed, every=True)) == ordered(brute.repeats(docs))
    assert suffix_dedup.remove_repeats(frame(spark, []), every=True).count() == 0
