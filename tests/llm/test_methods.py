"""What the operators do inside: models against plain Python, decoders against scalar loops, plans against their limits."""

import math
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import bpe, license_scan, media, near_dedup, packing, quality_classifier, quality_rules, registry


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = registry.queries()["op4_quality_classifier"](spark, sf)
    rows = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "quality", "score").collect()
    assert len(rows) > 1000 and all(0 <= r.score <= 1 for r in rows)
    good = [r.predicted == r.quality for r in rows]
    most = max(Counter(r.quality for r in rows).values()) / len(rows)
    assert sum(good) / len(good) > most
    assert np.mean([r.score for r in rows if r.quality == 1]) > np.mean([r.score for r in rows if r.quality == 0]) + 0.2


def test_classifier_without_labels(spark, docs):
    out = quality_classifier.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in out} == {0.5} and len(out) == docs.count()


def test_classifier_keeps_columns(spark, docs, sf):
    kept = quality_classifier.keep(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns


def plain_surprise(docs, side):
    """Mean bits a word of each (id, text, lang), by the definitions: the model of a language's other half, in dictionaries."""
    grams = {}
    for i, t, lang in docs:
        w = brute.words(t)
        grams.setdefault((lang, side[i]), Counter()).update(zip(w, w[1:], strict=False))

    def discounts(n):
        k = Counter(n)
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else 0.5
        return [max(0.05 * i, min(0.95 * i, i - (i + 1) * y * (k[i + 1] / k[i]) if k[i] else i)) for i in (1, 2, 3)]

    def bits(model, v, w):
        behind = Counter(y for _, y in model)
        d, e = discounts(model.values()), discounts(behind.values())
        left = sum(e[min(n, 3) - 1] for n in behind.values()) / sum(behind.values()) if behind else 1
        p = (behind[w] - e[min(behind[w], 3) - 1] if behind[w] else 0) / max(1, sum(behind.values())) + left / 2**quality_rules.BITS
        after = [n for (x, _), n in model.items() if x == v]
        rest = sum(d[min(n, 3) - 1] for n in after) / sum(after) if after else 1
        n = model[v, w]
        return -math.log2((n - d[min(n, 3) - 1] if n else 0) / max(1, sum(after)) + rest * p)

    out = {}
    for i, t, lang in docs:
        w = brute.words(t)
        model = grams.get((lang, 1 - side[i]), Counter())
        own = [bits(model, *g) for g in zip(w, w[1:], strict=False)]
        out[i] = sum(own) / len(own) if own else None
    return out


def test_language_model(spark, tmp_path):
    """Surprise and verdicts of documents in many small chunks, against dictionaries."""
    rng = np.random.default_rng(2)
    vocabulary = [f"{x}{i}" for i in range(30) for x in "ab"]
    rows = [(i, " ".join(vocabulary[k] for k in np.minimum(rng.geometric(0.08, int(rng.integers(0, 130))), 59)), (None, "en", "de")[i % 3]) for i in range(120)]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "one", "fr"), (203, "Never seen words " * 20, "fr"), (204, rows[7][1], rows[7][2])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    side = {r.doc_id: r.side for r in df.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS side").collect()}
    got = {r.doc_id: r for r in quality_rules.verdicts(df).collect()}
    want = plain_surprise(rows, side)
    assert got.keys() == want.keys()
    for i, s in want.items():
        assert (got[i].surprise is None) == (s is None) and abs((s or 0) - (got[i].surprise or 0)) <= 0.5 / quality_rules.STEPS, i
    failed = {i: b for i, *_, b in brute.rules([r[:2] for r in rows])}
    for lang in {r[2] for r in rows}:
        own = [i for i, _, x in rows if x == lang]
        bins = {i: math.floor(got[i].surprise / quality_rules.BIN + 0.5) for i in own if got[i].surprise is not None}
        fine = sorted(b for i, b in bins.items() if not failed[i])
        at = [fine[math.ceil(q * len(fine) - 1e-9) - 1] for q in (quality_rules.LOW, quality_rules.HIGH)] if fine else [0, 0]
        for i in own:
            assert got[i].base_failed == failed[i] and got[i].kept == (not failed[i] and (i not in bins or at[0] <= bins[i] <= at[1])), i
    assert any(not r.kept and not r.base_failed for r in got.values())


def scalar_adpcm(block: bytes):
    pred, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [pred]
    for b in block[4:]:
        for n in (b & 15, b >> 4):
            step = int(media.STEPS[index])
            d = (step >> 3) + (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
            pred = max(-32768, min(32767, pred - d if n & 8 else pred + d))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
            out.append(pred)
    return out


def test_adpcm_blocks():
    raw = np.random.default_rng(1).integers(0, 256, 64 * 5, dtype=np.uint8)
    got = media.adpcm(raw, 64)
    assert [r.tolist() for r in got] == [scalar_adpcm(raw[i : i + 64].tobytes()) for i in range(0, 320, 64)]


def test_companding_tables():
    assert media.ULAW_PCM[0] == -32124 and media.ULAW_PCM[128] == 32124 and media.ULAW_PCM[255] == 0
    assert media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x55] == -8 and abs(int(media.ALAW_PCM[0x2A])) == 32256


def test_media_columns(spark):
    ok, odd = media.wav(bytes(range(256))), media.wav(bytes(64) * 3, media.ADPCM, 8000, 64)
    df = spark.createDataFrame([(1, ok, "x"), (2, odd, "x"), (3, b"RIFFnonsense", "x"), (4, None, "x"), (5, media.wav(b""), "x")], "id long, media binary, status string")
    rows = {r.id: r for r in media.decode(df).collect()}
    assert [rows[i].status_decoded for i in range(1, 6)] == ["ok", "ok", "bad", "bad", "ok"]
    assert rows[1].n_samples == 512 and rows[2].n_samples == 2 * 3 * 121 and rows[5].n_samples == 0 and rows[4].pcm is None


def test_packing_plan():
    rng = np.random.default_rng(3)
    histogram = Counter(int(x) for x in np.clip(rng.lognormal(5, 1.2, 20_000), 1, 4096))
    groups = packing.plan(dict(histogram))
    packed = Counter()
    for size, n, items in groups:
        used = sum(x * k for x, k in items.items())
        assert used <= size and size in packing.SIZES and not any(used <= s < size for s in packing.SIZES)
        for x, k in items.items():
            packed[x] += n * k
    assert packed == histogram
    assert sum(x * n for x, n in histogram.items()) / sum(size * n for size, n, _ in groups) > 0.98


def test_packing_places(docs, pairs):
    rows = packing.pack(docs).collect()
    bins, whole = defaultdict(list), Counter()
    for r in rows:
        whole[r.doc_id] += r.length
        if r.length:
            bins[r.bin_id, r.bin_size].append((r.offset, r.offset + r.length))
        else:
            assert r.bin_id is None and r.bin_size is None and r.offset is None
    assert len(bins) == len({b for b, _ in bins})
    for (_, size), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= size and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    want = Counter()
    for i, t in pairs:
        want[i] += len(brute.words(t))
    assert whole == want


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


def test_crowded_bucket(spark):
    """Many texts around one passage: neighbours in an order are too few, blocks of the bucket find every link."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for p in rng.choice(120, 4, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.near(rows))


def test_template_bucket(spark):
    """Texts that share a template and stay apart (similarity about 0.7), with some true pairs among them and texts under one
    rare shingle that aren't similar either: no comparison of all with all, and every link."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        w = base + [f"x{i}_{p}" for p in range(40)]
        rows.append((i, " ".join(w)))
        if i % 100 == 0:
            rows.append((5000 + i, " ".join([*w[:-3], *(f"y{i}_{p}" for p in range(3))])))
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = {i: (i % 5000 if i >= 5000 else i) for i, _ in rows}
    assert {r.doc_id: r.component_id for r in got} == want
    some = [r for r in rows if r[0] % 5000 < 200]
    assert all(r[3] == (want[r[0]] == r[0]) for r in brute.near(some))
    sets = near_dedup._sets  # how many meet: only the true pairs share a rare shingle
    df = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(sets, "rep long, body array<long>")
    per = near_dedup.prefixes(df, 85).groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert per <= 2


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaaaaaaaaaaa", "abababababab aaabaaab", "the the the", " \n\n  x", "ééé"])
def test_merges_of_repeats(text):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = bpe.Bpe(f.read())
    placed, ids, at = bpe.encode_texts(model, [text])
    flat = [int(x) for w in placed[0] for x in ids[at[w] : at[w + 1]]]
    assert flat == model.library.encode(text, add_special_tokens=False).ids


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert {r.doc_id for r in rows} <= known and len(rows) == len({r.doc_id for r in rows})
        known = {r.doc_id for r in rows}
        docs = corpus_pipeline.common.stored(out)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == known
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr) == sorted(map(tuple, last), key=repr)


def test_pipeline_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, sf))
        assert docs.count() == 0


def test_oracles(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = duckdb.sql(sql)
        got = registry.queries()[name](spark, sf).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name


def test_near_threshold(spark):
    """A pair at similarity 84/102 goes in the pipeline's stage and stays apart in op10."""
    base = [f"w{i}" for i in range(97)]
    other = [*base[:88], *(f"x{i}" for i in range(9))]
    a, b = (brute.shingles(" ".join(x)) for x in (base, other))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.keep(df).collect()} == {1, 2}
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == {1}


def shuffled(spark):
    """Verdicts by doc_id: stretches of one long order of words, and as 1000 the words of document 0 in another order."""
    rng = np.random.default_rng(11)
    cycle = [f"word{i}" for i in rng.permutation(300)] * 2
    rows = [(i, " ".join(cycle[s : s + 90])) for i, s in enumerate(rng.integers(0, 300, 80).tolist())]
    rows.append((1000, " ".join(rng.permutation(rows[0][1].split()))))
    return {r.doc_id: r for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang")).collect()}


def test_word_order(spark):
    v = shuffled(spark)
    assert v[1000].surprise > 2 + max(r.surprise for i, r in v.items() if i < 1000)


def test_language_model_grows():
    """Distinct word 2-grams aren't bounded by an alphabet."""
    texts = [" ".join(f"w{i * 7 % 1009}x{i % n}" for i in range(n)) for n in (2000, 20_000)]
    n = [len(quality_rules.distinct(quality_rules.grams(*quality_rules.words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))[0], np.uint64(0))[0]) for t in texts]
    assert n[0] == 1999 and n[1] >= 19_990


def test_band_rejects(spark):
    """The band leaves out what the model finds incoherent, and the base rules don't."""
    v = shuffled(spark)
    assert not v[1000].base_failed and not v[1000].kept and sum(r.kept for r in v.values()) > 70


def test_wrapped_licenses():
    """A template is found in whatever way its lines are wrapped; words scattered over a long text aren't one."""
    index = license_scan.Templates({}, license_scan.TEMPLATES, license_scan.THRESHOLD)
    for t, (_, text) in enumerate(license_scan.TEMPLATES):
        w = text.lower().split()
        for k in range(len(w) + 1):
            wrapped = "before it\n" + " ".join(w[:k]) + "\n * " + " ".join(w[k:]) + "\nbehind it"
            assert index.match(wrapped.encode()).get(t) == 1.0, (text, k)
        assert index.match("\n".join(w).encode()).get(t) == 1.0
        assert t not in index.match((" " + "filler " * 40).join(w).encode())


def test_classifier_sample(spark, monkeypatch):
    """Texts that are null or don't fit leave the others in the sample; held-out labels don't move the curve."""
    ids = spark.range(60).where(~quality_classifier.held_out(quality_classifier.F.col("id"))).selectExpr("id AS doc_id").collect()
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 4000)
    rows = [(r.doc_id, None if k % 5 == 0 else "long " * 2000 if k % 5 == 1 else f"text {k} " * 5) for k, r in enumerate(ids)]
    labels = [(r.doc_id, k % 2) for k, r in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    known = spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1)
    got = quality_classifier.sample(docs, known)
    assert len(got) == sum(t is not None and len(t) <= 4000 for _, t in rows)
    short, long = [t for _, t in rows if t is not None and len(t) < 4000], "b" * 3950
    mixed = spark.createDataFrame([(i, long if k % 3 == 0 else "x") for k, (i, _) in enumerate(rows)], "doc_id long, text string").coalesce(1)
    assert len(short) == len(got) and sum(t == b"x" for _, t in quality_classifier.sample(mixed, known)) == sum(k % 3 > 0 for k in range(len(rows)))
    out = spark.range(900).where(quality_classifier.held_out(quality_classifier.F.col("id"))).selectExpr("id AS doc_id", "1 AS quality")
    assert quality_classifier.fit(docs, known) == quality_classifier.fit(docs, known.unionAll(out))
