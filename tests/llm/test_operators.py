"""Operators against brute force, SQL twins, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tablewise.llm import attention, jaccard_join, resampling
from tablewise.llm.common import distinct, split_words
from tablewise.llm.decontaminate import contamination
from tablewise.llm.mixing import mixed_sources
from tablewise.llm.personal import personal_data
from tablewise.llm.queries import ORACLES, QUERIES, vocabulary
from tablewise.llm.substrings import SuffixAutomaton, without_repeats
from tablewise.llm.token_store import build_mph, find_slots, lookup, write_store
from tablewise.llm.warc import derivatives, read_warc, responses, write_warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(sf):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet' ORDER BY 1").fetchall()


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_features_cost_little_more_than_their_words():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(3, 9))) for _ in range(50_000)]
    texts = pa.array([" ".join(draw.choices(words, k=400)) for _ in range(1_000)])

    def cpu(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    cells, bounds = resampling.features(texts)
    assert all((np.diff(cells[a:b]) > 0).all() for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    # Telling features apart by hashing took longer than all the rest.
    assert cpu(lambda: resampling.features(texts)) < 3 * cpu(lambda: split_words(texts).hashes())


def test_distinct_values_are_sorted_and_single():
    values = np.array([7, 2, 7, 1 << 63, 2, 0], np.uint64)
    assert distinct(values).tolist() == [0, 2, 7, 1 << 63]
    assert distinct(values[:0]).tolist() == []


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_twin(spark, sf, name):
    df = QUERIES[name](spark, sf)
    order = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(str([r[names.index(c)] for c in order]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == theirs


def test_token_store_holds_what_the_tokenizer_gives(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got, start = rows_of(QUERIES["op1_token_store"](spark, sf)), 0
    for doc, text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    from tablewise.llm.token_store import encoder

    hard = ["Don't stop!? it's 3.14", "<|endoftext|> a<|startoftext|>b", "É é é ß ﬁ Ǆ  x y", "a\x00b\x1fc", "中文abc,def", "___--__ '' ,'s", "", "ÀÉÎ-õü… —!"]
    enc, whole = encoder(vocabulary("word_bpe_49k.json")), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for batch in ([h] for h in hard):
        ids, _ = enc.encode(pa.array(batch), None)
        assert ids.tolist() == whole.encode(batch[0], add_special_tokens=False).ids, batch


def test_index_is_minimal_perfect_and_refuses_others(spark, tmp_path):
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    first, pilots, slots = build_mph(h)
    assert sorted(slots.tolist()) == list(range(len(h)))
    assert (find_slots(first, pilots, h) == slots).all()
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 300, 3)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    write_store(docs, path, vocabulary("word_bpe_49k.json"), 2, chars_per_shard=200, keys_per_index=30)
    found = lookup(spark, path, spark.range(300).toDF("doc_id")).collect()
    assert sorted(r.doc_id for r in found) == list(range(0, 300, 3))
    assert len({r.shard for r in found}) > 2


def test_pipeline_shards_keep_the_shuffled_order(spark, sf):
    import corpus_pipeline as c

    rows = [((i * 37) % 101 % 40, f"text {i} of words") for i in range(200)]  # five copies of a key, far apart
    rows += [(None, "no key"), (3, "late")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(c.tokens(spark, docs, sf).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_scattered_records_are_found_over_shards(spark, tmp_path):
    rows = [(i % 7, f"text {i}", 1000 - i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long")
    path = f"file://{tmp_path}/store"
    write_store(docs, path, vocabulary("word_bpe_49k.json"), 2, chars_per_shard=200, keys_per_index=30, order="place")
    found = lookup(spark, path, spark.range(9).toDF("doc_id")).collect()
    got = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.record))]
    assert got == [i for i, _, _ in reversed(rows)] and len({r.shard for r in found}) > 2


def test_decontamination_of_planted_passages(spark):
    item = " ".join(f"i{n}" for n in range(20))
    rows = [
        (1, "pad " * 100 + item + " pad" * 100),  # 20 of 220 words
        (2, "pad " * 1000 + item),  # fewer than a twentieth
        (3, " ".join(f"i{n}" for n in range(12)) + " pad"),  # no whole window
        (4, item.upper().replace(" ", "--")),
        (5, "short one"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (9, "Short, one!")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, bench, block_words=3).collect()}
    assert got == {1: (220, 20, 1, True), 2: (1020, 20, 1, False), 3: (13, 0, 0, False), 4: (20, 20, 1, True), 5: (2, 2, 1, True)}


def test_fingerprints_follow_their_definition(spark, sf, texts):
    got, n = rows_of(QUERIES["op5_syncmers"](spark, sf)), len(texts)
    for j, (doc, text) in enumerate(texts):
        q, following = len(text) // 4, texts[(j + 1) % n][1]
        edited = text[: len(text) - q] + following[:q]
        assert (got[doc].n_chars, got[doc].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[doc].near_next <= 1 and 0 <= got[doc].near_edited <= 1
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 > 10 * np.mean([r.near_next for r in got.values()])
    by_text = collections.defaultdict(set)
    for doc, text in texts:
        by_text[text].add(got[doc].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_syncmers_against_brute_force(spark):
    import xxhash

    from tablewise.llm.syncmers import NONE, with_fingerprint

    def h64(data, seed=42):
        v = xxhash.xxh64_intdigest(data, seed=seed & (2**64 - 1))
        return v - (1 << 64) if v >= 1 << 63 else v

    def many(*values):
        seed = 42
        for v in values:
            seed = h64(int(v).to_bytes(8, "little", signed=True), seed)
        return seed

    def brute(text):
        letters = [0, *(h64(p.encode()) for w in SPACED.findall(text) for p in (w[i : i + 8] for i in range(0, len(w), 8))), 1]
        pairs = [NONE] * 3 + [many(a, b) for a, b in zip(letters[:-1], letters[1:], strict=True)] + [NONE] * 3
        best = {}
        for i in range(len(pairs) - 3 if len(pairs) > 7 else 0):
            a, b, c, d = pairs[i : i + 4]
            if min(a, d) <= min(b, c):
                best.setdefault(many(a, b, c, d) & ((1 << 39) - 1), i)
        return [(v << 24) | p for v, p in sorted(best.items())[:64]]

    rows = ["", "a", "one two three four five six seven eight", "averyveryverylongword" * 9, "é ü ö " * 40, " ".join(str(i * i) for i in range(300))]
    df = with_fingerprint(spark.createDataFrame([(r,) for r in rows], "text string"), "text", "f")
    assert {r.text: list(r.f) for r in df.collect()} == {r: brute(r) for r in rows}


def test_resampling_finds_what_labels_teach(spark, sf):
    rng = random.Random(3)
    vocabulary_ = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(3600):  # enough labelled rows to attest a cell by eight standard errors
        kind = i % 9
        words = [rng.choice(vocabulary_) for _ in range(60)]
        if kind == 0:
            words[10], words[30] = "vile", "nasty"
        if kind == 1:
            words = [w + "###" if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in resampling.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    clean = [i for i, _ in rows if i % 9 > 1 and i % 2 == 0]
    bad = [i for i, _ in rows if i % 9 < 2 and i % 2 == 0]
    assert sum(i in kept for i in clean) >= 0.93 * len(clean)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("size", [3600, 5400])
def test_resampling_finds_toxic_words_of_small_languages(spark, size):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(size):
        lang = "es" if i % 10 == 0 else "en"  # a tenth of the rows, in words of their own
        words = [f"{lang}{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.choice([30, 120, 900]))]
        toxic = i // 10 % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = f"{'feo' if lang == 'es' else 'vile'}{rng.randrange(6)}"
        rows.append((i, " ".join(words), lang))
        if i % 2 == i // 50 % 2:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in resampling.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for lang in ("es", "en"):
        unseen = [i for i, _, own in rows if own == lang and i % 2 != i // 50 % 2]
        bad, good = [i for i in unseen if i // 10 % 5 == 0], [i for i in unseen if i // 10 % 5]
        assert bad and good
        assert sum(i in kept for i in bad) <= 0.15 * len(bad), (lang, size)
        assert sum(i in kept for i in good) >= 0.9 * len(good), (lang, size)


def test_kth_largest(spark):
    values = [random.Random(5).random() for _ in range(3000)] + [0.5] * 40
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 17, 1500, 3040, 9999):
        assert resampling.kth_largest(keys, k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert resampling.kth_largest(keys, 0) is None


def test_attention_gradients_are_right():
    rng = np.random.default_rng(0)
    model = attention.Attention(20, 5, seed=2)
    for n in model.w:
        model.w[n] = model.w[n].astype(np.float64)
    model.embedding = model.embedding.astype(np.float64)
    inputs = rng.integers(0, 20, (3, attention.BLOCK))
    classes, valid = rng.integers(0, 5, inputs.shape), rng.random(inputs.shape) < 0.8
    begins = np.array([True, False, True])
    grads, _, loss = model.gradients(inputs, begins, classes, valid)
    for name in ("q", "k", "v", "o", "place", "in", "out", "class", "class_b"):
        at = tuple(rng.integers(0, s) for s in model.w[name].shape)
        model.w[name][at] += 1e-5
        up = model.gradients(inputs, begins, classes, valid)[2]
        model.w[name][at] -= 1e-5
        assert abs((up - loss) / 1e-5 - grads[name][at]) < 1e-3, name


def test_attention_is_causal_and_batches_alike():
    rng = np.random.default_rng(1)
    model = attention.Attention(50, 8)
    classes = np.arange(51) % 8
    inside = np.log(1 / np.bincount(classes))[classes].astype(np.float32)
    scorer = attention.Scorer(model, classes, inside, 50)
    lengths = [0, 1, 15, 16, 17, 100]
    ids = [rng.integers(0, 50, n) for n in lengths]
    alone = [scorer.log10(i, np.array([0, len(i)]))[0] for i in ids]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    for size in (1, 3, 128):
        scorer.batches.__func__.__defaults__ = (size,)
        assert np.allclose(scorer.log10(np.concatenate(ids), bounds), alone, atol=1e-3)
    # The probabilities of what may follow sum to 1: every next id, or the end.
    base = scorer.log10(ids[2], np.array([0, 15]))[0]
    z = model.forward(*[x[:1] for x in (attention.blocks_of(ids[2], np.array([0, 15]), 50)[0],)], np.array([True]))["z"][0, 15]
    share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert abs((share[classes] * np.exp(inside)).sum() - 1) < 1e-4 and base < 0


def test_base_scores_and_the_model_learns(spark, sf, texts):
    got = rows_of(QUERIES["op7_attention_scores"](spark, sf))
    docs = [(i, SPACED.findall(t.translate(LOWER))) for i, t in texts]
    counts = collections.Counter()
    for i, w in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*w, None])
    total = sum(counts.values())
    under = total + 0.5 * (len(counts) + 1)
    for i, w in docs:
        base = sum(math.log10((counts.get(x, 0) + 0.5) / under) for x in [*w, None])
        row = got[i]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w) + 1, total)
        assert row.n_known == sum(x in counts for x in [*w, None]) and abs(row.base_score - base) < 1e-6 * max(1, -base)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    held = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts if got[i].held_out}
    assert sum(got[i].score for i in held) > 0.7 * sum(held.values()) * math.log10(1 / 49409)


def test_attention_learns_from_every_training_text(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(attention, "FIT_IDS", 600, raising=False)  # more tasks than are added at once
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    words = [w for w in (tokenizer.id_to_token(i).removesuffix("</w>") for i in range(49_000)) if re.fullmatch("[a-z]{4,9}", w)]
    rows = list(enumerate(dict.fromkeys(words)))[:9000]  # most of their ids are in one text each
    assert len(rows) > 8000
    docs = attention._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    coded = attention.stored(attention._encoded(docs, vocabulary("word_bpe_49k.json")), "ids")
    scorer = attention.fit(coded, vocabulary("word_bpe_49k.json"))
    seen = {i for n, w in rows if zlib.crc32(str(n).encode()) % 5 != 1 for i in tokenizer.encode(w, add_special_tokens=False).ids}
    start = attention.Attention(49_408, attention.FREQUENT + attention.SHARED).embedding
    learnt = np.flatnonzero((scorer.model.embedding[: len(start) - 2] != start[:-2]).any(axis=1))
    assert len(seen) > 6000 and seen <= set(learnt.tolist())


def test_suffix_automaton_gives_first_places():
    rng = random.Random(0)
    passages = [np.array([rng.randrange(3) for _ in range(40)], np.uint64) for _ in range(4)]
    auto = SuffixAutomaton(passages, 5)
    text, ends = [], []
    for p in passages:
        ends.append(len(text))
        text += [*p.tolist(), None]
    assert auto.starts.tolist() == ends
    stream = np.array([rng.randrange(4) for _ in range(400)], np.uint64)
    want = []
    for i in range(len(stream) - 4):
        own = stream[i : i + 5].tolist()
        want.append(next((j for j in range(len(text) - 4) if text[j : j + 5] == own), -1))
    assert auto.first_places(stream).tolist() == want


def brute_repeats(rows, window=35):
    counts = collections.Counter()
    split = [(i, SPACED.findall(t)) for i, t in rows]
    for _, w in split:
        counts.update(tuple(w[a : a + window]) for a in range(len(w) - window + 1))
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if counts[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_repeats_against_brute_force(spark, texts):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    more = []
    for i in range(40):  # one popular passage in ever other surroundings, cut at other places
        a, b = rng.randrange(0, 20), rng.randrange(45, 61)
        more.append((10_000 + i, " ".join([f"u{i}_{j}" for j in range(30)] + passage[a:b] + [f"v{i}_{j}" for j in range(5)])))
    more += [(20_000, " ".join(passage[:40] * 3)), (20_001, " ".join(["same"] * 100)), (20_002, " ".join(passage[:34]))]
    more += [(20_003 + i, more[0][1]) for i in range(3)]
    rows = [*texts[:120], *more]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in without_repeats(docs).collect())
    assert got == sorted(brute_repeats(rows))


def shingles(text, size):
    w = SPACED.findall(text.translate(LOWER))
    return frozenset(tuple(w[a : a + size]) for a in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("tile", [256, 4])
def test_components_against_brute_force(spark, texts, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    more = []
    for i in range(60):  # a group of near copies, of which many pairs are beyond the threshold
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(80)] = f"c{i}_{rng.randrange(3)}"
        more.append((5000 + i, " ".join(own)))
    rows = [*texts[:120], *more]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows, 3, 90)


def test_only_clusters_with_pairs_left_go_on():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(1, 1 << 62, 200).astype(np.uint64))
    other = np.unique(rng.integers(1, 1 << 62, 200).astype(np.uint64))
    sets = [np.append(base[2:], np.uint64(i)) for i in range(6)] + [other, other[1:]]
    n = np.array([len(s) for s in sets])
    sigs = [jaccard_join.signature(s) for s in sets]
    args = (list(range(8)), n, sigs, np.arange(8), [set() for _ in sets], None, 90)
    pairs, left = jaccard_join.candidate_pairs(*args, 1)
    # Six near copies need five tests, two need one and leave nothing untested.
    assert len(pairs) == 6 and len({c for *_, c in pairs}) == 2
    every, none = jaccard_join.candidate_pairs(*args, 0)
    untested = {frozenset(p[:2]) for p in every} - {frozenset(p[:2]) for p in pairs}
    assert len(every) == 16 and len(untested) == 10 and none == {}
    assert set(left) == {i for p in untested for i in p} and len(set(left.values())) == 1


def test_contexts_discover_what_the_patterns_miss(spark):
    rng = random.Random(4)

    def filler():
        return " ".join(rng.choice("lorem ipsum dolor sit amet tempor magna".split()) for _ in range(20))

    rows = [(i, f"{filler()} call me under +49 30 1234{i:04d} {filler()}") for i in range(12)]
    rows += [(100, f"{filler()} call me under 0301234777, {filler()}"), (101, f"{filler()} year 2024 {filler()} 77312")]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)[100]
    start = text.index("0301234777")
    assert (got[100].spans, got[100].n_phone, got[100].n_found) == (f"phone:{start}:{start + 10}", 0, 1)
    assert got[101].spans == "" and all(got[i].n_phone == 1 for i in range(12))


def test_numbers_in_groups_are_found_whole(spark):
    def luhn(body):
        return next(body + str(c) for c in range(10) if is_valid("card", body + str(c)))

    long_word = "k" * 300
    rows = []
    for i in range(60):
        card = luhn(f"411111111111{i:03d}")
        rows.append((i, f"as you asked my card number {card} is new"))
        rows.append((100 + i, f"so please call +1 555 123 {4000 + i} before noon"))
        rows.append((200 + i, f"the {long_word} hotline +1 555 987 {4000 + i} is open"))
    asked = {
        900: ("my card number 4111 1111 1111 1112", "card", "4111 1111 1111 1112"),
        901: ("so please call 555 123 4567", "phone", "555 123 4567"),
        902: ("please call (555) 123-4567, thanks", "phone", "555) 123-4567"),
        903: (f"the {long_word} hotline 555/987/1234!", "phone", "555/987/1234"),
        904: ("please call 5551 12th", "phone", "5551"),
        905: ("we please call\n555.123.4567.", "phone", "555.123.4567"),
    }
    rows += [(i, t) for i, (t, _, _) in asked.items()]
    rows += [(990, "1 " * 20_000 + "x"), (991, "please call " + "1-" * 20_000 + "x"), (992, "one two 12 34 56"), (993, "9" * 20_000 + "x")]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, kind, found) in asked.items():
        start = text.index(found)
        assert (got[i].spans, got[i].n_found) == (f"{kind}:{start}:{start + len(found)}", 1), text[:60]
    assert got[990].n_found == got[992].n_found == got[993].n_found == 0
    assert all(r.n_found == 0 for i, r in got.items() if i < 900)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    luhn = sum(int(c) if not i % 2 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in text.split(".")) if kind == "ip" else True,
        "card": 13 <= len(digits) <= 19 and luhn,
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def test_base_spans_against_the_plain_patterns(spark, texts):
    hard = [
        "a@b.c_d@e.f x a@b.c.@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3.0256", "\x01a@b.co\x02 +1 (234) 555-0100",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "é ö 4111111111111111 ü a%b@c-d.e", "+12 345 678 901+1 234567890-",
        "9" * 50 + " 1234567890123452", "1 " * 3000 + "@.+", "ab@" * 500 + "@x.y",
    ]
    rows = [*texts, *((10_000 + i, h) for i, h in enumerate(hard))]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text) if is_valid(k, m.group())]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text[:80]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))


def test_poisson_copies_have_their_means(spark):
    rows = [(i, "x" * 10, "big" if i % 10 else "small") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed_sources(docs, {"big": 0.5, "small": 0.5}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in got}
    assert abs(counts["small"] - 3000) < 4 * 3000**0.5 and abs(counts["big"] - 3000) < 4 * 3000**0.5
    # A rate above 16 is drawn in parts.
    rare = mixed_sources(docs, {"big": 0.02, "small": 0.98}).where("source = 'small'").groupBy("doc_id").count()
    few = spark.createDataFrame([(i, "x", "r" if i < 40 else "c") for i in range(4000)], "doc_id long, text string, source string")
    many = mixed_sources(few, {"r": 0.5, "c": 0.5}).where("source = 'r'").count()
    assert rare.count() > 500 and abs(many - 2000) < 5 * 2000**0.5


def test_warc_files_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = derivatives(responses(pages))
    path = f"file://{tmp_path}/warc"
    written = write_warc(made.repartition(3), path, "2024-01-01T00:00:00Z").agg({"records": "sum"}).first()[0]
    read = read_warc(spark, path).collect()
    assert written == len(read) == made.count()
    want = {r.record_id: r for r in made.collect()}
    for r in read:
        own = want[r.headers["WARC-Record-ID"]]
        assert (r.block, r.headers["WARC-Refers-To"], r.headers["WARC-Block-Digest"]) == (own.block, own.refers_to, own.block_digest)
        assert r.headers["WARC-Source-Payload-Digest"] == own.source_digest


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # 200 labels attest next to nothing; a thousand documents are the least that shows an effect.
    larger = sf.replace("sf0.001", "sf0.01")
    most = spark.read.parquet(f"{larger}/documents.parquet")
    first = c.quality(spark, most, larger)
    assert first.columns == docs.columns and 0 < first.count() < most.count()
    single = c.near_duplicates(spark, docs, sf)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (n, g) in groups.items() if g == i)
    bad = {r.doc_id for r in contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    clean = {r.doc_id for r in c.decontamination(spark, docs, sf).collect()}
    assert bad and clean == {i for i, _ in rows} - bad
    mixed = c.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns
    twice = spark.createDataFrame(mixed.collect(), mixed.schema)
    tokens = c.tokens(spark, twice, sf).collect()
    assert collections.Counter(r.doc_id for r in tokens) == collections.Counter(r.doc_id for r in twice.collect())
