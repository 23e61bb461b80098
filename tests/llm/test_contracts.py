"""The digests of every operator against brute force, on documents with nulls, empty and long texts, ties, copies."""

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, byte_dedup, license_scan, media, near_dedup, quality_rules, substring_dedup, token_count


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def want(rows):
    return sorted(map(tuple, rows), key=repr)


def test_substring_dedup(docs, pairs):
    assert got(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring_dedup(pairs))


@pytest.mark.parametrize("window", [5, 8])
def test_short_windows(docs, pairs, window):
    assert got(substring_dedup.digest(docs, window), "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring_dedup(pairs, window))


def test_removal_keeps_what_the_digest_keeps(docs):
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns
    kept = {(r.doc_id, brute.sha(" ".join(brute.words(r.text)))) for r in out.collect()}
    assert kept == {(r.doc_id, r.kept_sha256) for r in substring_dedup.digest(docs).collect()}


def test_byte_dedup(docs, pairs):
    some = [p for p in pairs if p[1] is None or len(p[1]) < 30_000]
    df = docs.where("text is null or length(text) < 30000")
    assert got(byte_dedup.digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(brute.byte_dedup(some))


def test_byte_spans_and_removal(docs):
    out, spans = byte_dedup.remove(docs), byte_dedup.spans(docs).collect()
    assert out.columns == docs.columns
    digests = byte_dedup.digest(docs).collect()
    assert {(r.doc_id, r.n_removed) for r in digests if r.n_removed} == {(i, n) for i, _, n in sums(spans)}
    assert sum(r.n_spans for r in digests) == len(spans) and all(r.end - r.start >= 400 for r in spans)
    kept, whole = {r.doc_id: r.kept_sha256 for r in digests}, {r.doc_id: r.text for r in docs.collect()}
    cut = {r.doc_id for r in spans}
    for r in out.collect():
        if r.doc_id not in cut:
            assert r.text == whole[r.doc_id]
        elif (whole[r.doc_id] or "").isascii():
            assert brute.sha(r.text) == kept[r.doc_id]
    assert {900_006, 900_007, 900_010} <= cut and 900_004 not in cut


def test_maximal_repeats(spark):
    rng = np.random.default_rng(5)
    make = lambda n: bytes(rng.integers(97, 101, n).tolist()).decode()
    one, two = make(300), make(180)
    texts = {1: one + make(50) + two, 2: make(20) + one[:200] + two[:150], 3: one, 4: one, 5: make(30) + two + one[100:] + make(9), 6: "abcd" * 60, 7: make(99), 8: "", 9: one[50:280] + one[50:280], 10: two + "z"}
    df = spark.createDataFrame([*texts.items(), (11, None)], "doc_id long, text string")
    rows = byte_dedup.groups(df, 100).collect()
    want = brute.maximal_repeats({k: v.encode() for k, v in texts.items()}, 100)
    assert {(r.doc_id, r.start, r.length) for r in rows} == want and len(rows) == len(want) > 20
    assert all(len({texts[r.doc_id][r.start : r.start + r.length] for r in rows if r.repeat == x}) == 1 for x in {r.repeat for r in rows})


def sums(spans):
    """(doc_id, at, removed bytes) of the rows that lose some."""
    total = {}
    for r in spans:
        total[r.doc_id, r.at] = total.get((r.doc_id, r.at), 0) + r.end - r.start
    return [(*k, n) for k, n in total.items()]


def test_media(docs, pairs):
    df = docs.mapInArrow(lambda it: media._digest(b.select([0, 1]) for b in it), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_samples long")
    assert got(df, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want(brute.media(pairs))
    twice = df.where("doc_id in (900006, 900007)").select("media_sha256", "feature").distinct()
    assert twice.count() == 1


def test_licenses(docs, pairs):
    assert got(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want(brute.licenses(pairs))


def test_rules(docs, pairs):
    v = quality_rules.verdicts(docs)
    assert got(v, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want(brute.rules(pairs))
    assert v.where("kept and base_failed").count() == 0


def test_near(docs, pairs):
    df = docs.where("doc_id is not null")
    out = near_dedup.components(df)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == want(brute.near([p for p in pairs if p[0] is not None]))
    assert near_dedup.keep(docs).columns == docs.columns


def test_token_counts(docs, pairs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expect = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs]
    assert got(token_count.counts(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id", "n_bytes", "n_tokens") == want(expect)


def test_bpe(docs, pairs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    expect = []
    for i, t in pairs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        expect.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids, skip_special_tokens=False))))
    assert got(bpe.digest(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(expect)


def test_encode_decode(docs, pairs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs.where("doc_id is not null and text is not null")
    back = bpe.decode(bpe.encode(df, path), path)
    assert got(back, "doc_id", "text") == want([p for p in pairs if None not in p])


def test_empty_tables(none):
    for f in (substring_dedup.digest, substring_dedup.remove, byte_dedup.digest, byte_dedup.spans, byte_dedup.remove, byte_dedup.groups, license_scan.scan, quality_rules.verdicts, quality_rules.keep, near_dedup.components, near_dedup.keep, lambda d: bpe.digest(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: token_count.counts(d, public_tokenizers.path("word_bpe_49k.json"))):
        assert f(none).agg(F.count("*")).first()[0] == 0
