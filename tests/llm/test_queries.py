"""Each query against its SQL or a brute-force version, over odd rows and over no rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from quaestor.llm import language_mixture, line_crf, line_rules, simhash, suffix_dedup, toxic_segments, warc
from quaestor.llm.common import remainder
from quaestor.llm.queries import QUERIES, SQL, public_vocabulary
from tests.compare import canonical, rows_of
from tests.llm.test_near_copies import groups_by_hand


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("tables", ["odd", "empty", "small"])
def test_query_equals_its_sql(spark, odd_tables, empty_tables, name, tables):
    folder = {"odd": odd_tables, "empty": empty_tables, "small": "/root/testdata/sf0.001"}[tables]
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        path = f"{folder}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path if tables == 'small' else path + '/*.parquet'}'")
    result = QUERIES[name](spark, folder)
    expected = con.execute(SQL[name])
    assert rows_of(result.columns, result.collect()) == rows_of([x[0] for x in expected.description], expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op13_whitening"}))
def test_query_has_a_row_for_each_row_and_none_for_none(spark, odd_tables, empty_tables, name):
    expected = Counter(canonical(x) for x, _ in documents(spark, odd_tables))
    rows = QUERIES[name](spark, odd_tables).collect()
    assert Counter(canonical(r.doc_id) for r in rows) == expected
    assert QUERIES[name](spark, empty_tables).count() == 0
    for row in rows:
        if "held_out" in row:
            divisor, rest = (4, 2) if name.startswith("op2_") else (5, 0)
            assert row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % divisor == rest)
            assert 0 <= row.score <= 1


def covered_by_hand(rows, length):
    """For each different row the bytes of its text that a string covers which began earlier."""
    keys = sorted({(d is None, d or 0, t is not None, t or "") for d, t in rows})
    seen, out = set(), {}
    for key in keys:
        text = key[3].encode()
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if text[at : at + length] in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(text[at : at + length])
        out[key] = gone
    return out


def cut_by_hand(rows, length):
    """The rows without repeats; a character goes with any of its bytes that are left incomplete."""
    covered = covered_by_hand(rows, length)
    out = []
    for d, t in rows:
        gone = covered[d is None, d or 0, t is not None, t or ""]
        kept = bytes(x for x, g in zip((t or "").encode(), gone) if not g)
        out.append((d, t if not any(gone) else kept.decode("utf-8", "ignore")))
    return out


def removed_by_hand(rows, length):
    out = {}
    for key, gone in covered_by_hand(rows, length).items():
        text = key[3].encode()
        kept = bytes(x for x, g in zip(text, gone) if not g)
        out[key] = (len(text), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return Counter((canonical(d), *out[d is None, d or 0, t is not None, t or ""]) for d, t in rows)


def test_op1_equals_brute_force(spark, odd_tables):
    rows = QUERIES["op1_suffix_dedup"](spark, odd_tables).collect()
    assert Counter((canonical(r[0]), *r[1:]) for r in rows) == removed_by_hand(documents(spark, odd_tables), suffix_dedup.LENGTH)


def test_repeats_keep_all_columns_and_frequent_grams_change_nothing(spark, odd_tables, monkeypatch):
    whole = spark.read.parquet(f"{odd_tables}/documents.parquet")
    expected = removed_by_hand(documents(spark, odd_tables), suffix_dedup.LENGTH)
    for frequent in (1, 10**9):
        monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
        cut = suffix_dedup.without_repeats(whole)
        assert cut.columns == [*whole.columns, "repeats"]
        assert Counter((canonical(r.doc_id), *r.repeats) for r in cut.collect()) == expected


def test_runs_are_found_in_bounded_memory():
    """One batch of 16 MB, as Spark hands it to a task: the runs leave in small batches, and a task holds few times its text."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = pa.array([rng.integers(97, 123, 4000, np.uint8).tobytes().decode() for _ in range(4000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([0] * 4000, pa.int32()), texts], names=["k", "ord", "text"])
    tracemalloc.start()
    largest = max(out.num_rows for out in suffix_dedup._named_runs(iter([batch]), suffix_dedup.LENGTH, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert largest <= 1 << 16
    assert peak < 64 << 20


def test_longest_previous_factors():
    raw = np.frombuffer(b"abcabcabdxabcabcab" + bytes(range(60)) + b"abcabcabdxabcabcab" + bytes(range(60, 120)), np.uint8)
    starts = np.arange(len(raw) - 34)
    got = suffix_dedup.longest_previous_factors(raw, starts, 34)
    for i in starts:
        best = 0
        for j in range(i):
            n = 0
            while n < 34 and raw[i + n] == raw[j + n]:
                n += 1
            best = max(best, n)
        assert got[i] == best


def components_by_hand(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_op5_equals_brute_force(spark, odd_tables):
    rows = QUERIES["op5_simhash"](spark, odd_tables).collect()
    texts = documents(spark, odd_tables)
    prints = [simhash.fingerprint(t) for _, t in texts]
    label = components_by_hand(prints)
    least = {}
    for (d, _), x in zip(texts, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    expected = Counter((canonical(d), f"{p:016x}", canonical(least.get(x))) for (d, _), p, x in zip(texts, prints, label))
    assert Counter((canonical(r.doc_id), r.fingerprint, canonical(r.component_id)) for r in rows) == expected


def test_gray_index_joins_chains_across_blocks():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(60)]))
    values = values[np.argsort(simhash.gray_rank(values))]
    labels = simhash.GrayIndex(values, np.array([0, len(values)])).join(simhash.DISTANCE)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= simhash.DISTANCE
    left, right = np.nonzero(near)
    assert (labels == simhash.united(np.arange(len(values)), left, right)).all()


def test_op6_equals_the_library(spark, odd_tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_vocabulary())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = Counter()
    for d, text in documents(spark, odd_tables):
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected[canonical(d), len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((canonical(r[0]), *r[1:]) for r in QUERIES["op6_bpe"](spark, odd_tables).collect()) == expected


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in QUERIES["op2_language_mixture"](spark, folder).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in found]) > 0.97
    for name, label in (("op9_toxic_segments", "toxic"), ("op10_line_crf", "quality")):
        found = [r for r in QUERIES[name](spark, folder).collect() if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in found]) > 0.9, name


def test_mixture_names_both_languages():
    counts = np.full((language_mixture.CLASSES, 2), 0.01)
    texts = ("mama papa lala nana " * 20, "zizi wuwu kyky xoxo " * 20)
    for i, text in enumerate(texts):
        np.add.at(counts[:, i], language_mixture.classes_of(text), 1)
    model = language_mixture.Languages(["aa", "zz"], counts / counts.sum(axis=0))
    assert [x for x, _ in language_mixture.languages_of(texts[0] * 3 + texts[1], model)] == ["aa", "zz"]
    assert [x for x, _ in language_mixture.languages_of(texts[1], model)] == ["zz"]
    assert language_mixture.languages_of("12 34", model) == []


def test_maximal_segments_are_maximal():
    rng = np.random.default_rng(4)
    for _ in range(200):
        scores = rng.integers(-3, 4, 24).astype(float)

        def split(low, high):
            best = max(((scores[a:b].sum(), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return split(low, best[2]) + [best[0]] + split(best[3], high)

        assert sum(x for _, _, x in toxic_segments.maximal_segments(scores)) == sum(split(0, len(scores)))


def test_cleaned_text_keeps_good_lines():
    assert line_rules.cleaned("A good line of words.\nno end\n\nAll rights reserved.") == "A good line of words.\n"


def test_archives_round_trip_and_damage_is_noticed(spark, odd_tables, tmp_path):
    pages = spark.read.parquet(f"{odd_tables}/pages.parquet")
    archives = warc.write_archives(pages, str(tmp_path / "warc"))
    payloads = Counter(r.payload for r in warc.read_archives(archives).collect() if r.record_type == "response")
    assert set(payloads) == {r.html or "" for r in pages.collect()}
    path = archives.first().path
    data = open(path, "rb").read()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and data[8 + int.from_bytes(data[4:8], "little") :].startswith(warc.ZSTD_FRAME)
    with open(path, "wb") as file:
        file.write(data[:-3])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.frames(path))
    with pytest.raises(ValueError, match="announced"):
        warc.parsed(warc.record(1, "u", b"x" * 10, hashlib.sha256(b"x" * 10).hexdigest(), None, False)[:-1])
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(warc.record(1, "u", b"x" * 10, "0", None, False))


def shingles_of(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_equals_brute_force(spark, odd_tables):
    """Each stage by hand on what the stage before it left; only the fitted chain is shared."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    labels = spark.read.parquet(f"{odd_tables}/labels.parquet").where(remainder(5) != 0)
    chain = line_crf.fitted(docs, labels)
    rows = [(d, t) for d, t in documents(spark, odd_tables) if score_by_hand(t, chain) >= 0.3]

    groups = groups_by_hand(rows)
    rows = [min(group, key=lambda x: (x[0] is None, x[0] or 0)) for group in groups]
    for group, (least, text) in zip(groups, rows):  # no tie of an id with two texts, so the order says which row stays
        assert {t for d, t in group if d == least} == {text} or not (text or "").strip()

    rows = cut_by_hand(rows, suffix_dedup.LENGTH)
    items = items_of_one_id(spark, odd_tables)
    items += [shingles_of(r.text) for r in spark.read.parquet(f"{odd_tables}/benchmark.parquet").where("item_id is null").collect()]
    leaks = [any(i and len(i & shingles_of(t)) >= 0.8 * len(i) for i in items) for _, t in rows]
    assert 0 < sum(leaks) < len(rows)
    rows = [row for row, leak in zip(rows, leaks) if not leak]

    library = Tokenizer.from_file(public_vocabulary())
    expected = Counter((canonical(d), *library.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    found = corpus_pipeline.run(spark, odd_tables).collect()
    assert Counter((canonical(r.doc_id), *r.input_ids) for r in found) == expected


def items_of_one_id(spark, folder):
    """Shingles of the benchmark rows of each id, taken together."""
    out = {}
    for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        if row.item_id is not None:
            out.setdefault(row.item_id, set()).update(shingles_of(row.text))
    return list(out.values())


def score_by_hand(text, chain):
    """Marginals of the lines by the forward-backward recursion over probabilities, one line at a time."""
    features, lengths, _ = line_crf.line_features(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
    odds = features.astype(float) @ chain.weights
    if not len(odds):
        return chain.prior
    step = np.array([[np.exp(chain.bad), 1.0], [1.0, np.exp(chain.good)]])
    emit = np.stack([np.ones(len(odds)), np.exp(odds)], axis=1)
    forward, backward = np.zeros_like(emit), np.ones_like(emit)
    forward[0] = emit[0] / emit[0].sum()
    for i in range(1, len(odds)):
        forward[i] = (forward[i - 1] @ step) * emit[i]
        forward[i] /= forward[i].sum()
    for i in range(len(odds) - 2, -1, -1):
        backward[i] = step @ (emit[i + 1] * backward[i + 1])
        backward[i] /= backward[i].sum()
    good = forward * backward
    good = good[:, 1] / good.sum(axis=1)
    return float((good * lengths).sum() / lengths.sum())


@pytest.mark.parametrize("names", [["repeats", "row", "rest"], ["kept", "label", "n"]])
def test_pipeline_stages(spark, odd_tables, empty_tables, names):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").select("*", *[F.lit(i).alias(x) for i, x in enumerate(names)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, odd_tables), f"test-{name}")
        if name != "tokens":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    assert docs.count() == before.count()
    kept = {r.doc_id for r in before.collect()}
    assert 60 not in kept  # it is a benchmark item; the copy of it in 61 was cut out before
    assert len(kept & {7, *range(100, 112)}) <= 1  # copies of one text
    assert corpus_pipeline.run(spark, empty_tables).count() == 0


def test_op10_scores_equal_the_recursion_by_hand(spark, odd_tables):
    chain = line_crf.fitted(spark.read.parquet(f"{odd_tables}/documents.parquet"), spark.read.parquet(f"{odd_tables}/labels.parquet").where(remainder(5) != 0))
    expected = sorted((canonical(d), score_by_hand(t, chain)) for d, t in documents(spark, odd_tables))
    found = sorted((canonical(r.doc_id), r.score) for r in QUERIES["op10_line_crf"](spark, odd_tables).collect())
    assert [x for x, _ in found] == [x for x, _ in expected]
    assert [x for _, x in found] == pytest.approx([x for _, x in expected], abs=1e-9)
