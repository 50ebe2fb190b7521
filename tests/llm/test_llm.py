"""Each operator against brute force, a round trip or held-out accuracy, and its odd inputs."""

import glob
import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq_file
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lakemill.llm import bpe, decontam, kdshard, langid, linededup, lmscore, pq, queries, rans, runs, simhash, toxicity
from tests.conftest import SF
from tests.oracle import connect, same

LARGER = SF.replace("0.001", "0.01")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n", "one", "Ünï çødé, 'tis\tété 12345", "x" * 300_000, "same text twice here it is", "same text twice here it is"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, None if k % 3 else "en", None, None) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def test_lm_base_score_and_fold(spark, rows):
    got = queries.op1_lm_scores(spark, SF).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    counts = Counter()
    for i, t in rows.items():
        if fold(i) != 1:
            counts.update([*t.encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        tokens = [*rows[r.doc_id].encode().lower().split(), b"\n"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[t] > 0 for t in tokens), n, fold(r.doc_id) == 1)
        assert r.score < 0
    # So few texts teach little about others, but much about themselves.
    seen = [r for r in got if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_lm_paths_are_probabilities():
    """Over all symbols the paths, each half-half, with what they leave open sum to one; at any cut of the tree."""
    counts = np.array([900, 500, 300, 40, 7, 3, 3, 1])
    for share in (0.0, 0.01, 0.2):
        start, length, node, bit, rest = lmscore.huffman(counts, share)
        assert abs((0.5 ** length * 2.0**rest).sum() - 1) < 1e-6
        assert len(node) == len(bit) == length.sum()
    found = lmscore.SlotCounts(16)
    found.add(np.array([1, 0, 1], np.uint8), [np.array([7, 7, 7])])
    assert found.sums[14:16].tolist() == [1, 2]


def test_lm_reads_tokens_as_split_does(monkeypatch):
    texts = [b"", b" ", b"One two\tTHREE\x0bfour\x1cfive ", "Été ça\n\n".encode(), b"x" * 200, b"one " * 3000]
    coder = lmscore.Coder([b"one", b"two", "ça".encode()], np.array([9, 5, 3]), 30, 3)
    place = {b"one": 0, b"two": 1, "ça".encode(): 2}
    for stretch in (runs.STRETCH, 50):
        monkeypatch.setattr(runs, "STRETCH", stretch)
        monkeypatch.setattr(lmscore, "STRETCH", stretch)
        for text, got in zip(texts, coder.read(texts)):
            want = text.lower().split()
            assert got.place.tolist() == [place.get(w, -1) for w in want]
            assert got.tail == [w for w in want if w not in place] and len(got.hashed) == len(got.context) == len(want)


def test_lm_chunks_move_with_their_text():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 1 << 64, n, np.uint64) for n in (400, 30, 57))
    one, two = (lmscore.chunks(np.concatenate([x, shared])) for x in (a, b))
    assert len(set(zip(one[1].tolist(), one[2].tolist())) & set(zip(two[1].tolist(), two[2].tolist()))) > 8
    assert [len(x) for x in lmscore.chunks(np.zeros(0, np.uint64))] == [0, 0, 0]


def test_lm_tells_copied_texts_and_unseen_ones(spark):
    """Held-out texts do better than the unigram on what it can say, its known words; copies cost next to nothing."""
    rng = np.random.default_rng(8)
    draw = lambda lang, n: " ".join(f"{lang}{k}" for k in rng.zipf(1.3, n) % 500)
    texts = [draw("ab"[k % 2], 500) for k in range(300)]
    texts += texts[:20]
    got = {r.doc_id: r for r in lmscore.score_texts(frame(spark, texts), F.col("doc_id") % 5 != 1).collect()}
    fresh = [got[k] for k in range(20, 300) if k % 5 == 1]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    # Training texts with a copy in training.
    copied = [got[k] for k in range(300, 320) if k % 5 != 1]
    assert len(copied) == 16 and sum(r.score for r in copied) > 0.3 * sum(r.base_score for r in copied)
    assert all(r.score < 0.6 * r.base_score for r in fresh)


def test_language_id_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    got = [r for r in queries.op2_language_id(spark, LARGER).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_shards(spark, rows):
    got = queries.op3_kd_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    by = {}
    for r in got:
        raw = rows[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(40))
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))


def test_shards_cut_one_hot_text(spark):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("copy of one text").alias("text"))
    sizes = [r["s"] for r in kdshard.kd_shards(hot, shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def slow_fingerprint(text):
    found = text.encode().lower().split()
    grams = [b" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_all_pairs(spark, rows):
    prints = {i: slow_fingerprint(t) for i, t in rows.items()}
    label = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for i in prints:
            least = min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
            moved, label[i] = moved or least < label[i], min(least, label[i])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_components(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_covering_finds_every_pair_in_crowds(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for _ in range(500)})
    want = {(min(a, b), max(a, b)) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3}
    got = simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), 3)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_sketches_show_no_more_than_the_difference():
    rng = np.random.default_rng(12)
    for n in (0, 1, 40, 700, 5000):
        both, x, y = (np.unique(rng.integers(0, 1 << 63, k, np.uint64)) for k in (n, n // 3, n // 9))
        one, two = (simhash.sketch(np.unique(np.concatenate([both, part]))) for part in (x, y))
        bits = int(np.bitwise_count(one ^ two).sum())
        assert bits <= len(x) + len(y) and (n > 700 or bits > 0.5 * (len(x) + len(y)) or not n // 3)
        assert not (simhash.sketch(both) ^ simhash.sketch(both)).any()


def test_near_duplicates(spark):
    words = [f"word{k}" for k in range(200)]
    edited = [*words[:100], "other", *words[101:]]
    texts = [" ".join(words), " ".join(edited), " ".join(words), " ".join(f"else{k}" for k in range(200)), " ".join(words[:100]), None, ""]
    kept = simhash.near_duplicates(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5] and kept.columns == frame(spark, texts).columns


def test_near_duplicates_of_a_crowd_are_one(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    crowd = [" ".join([*words[:k], "edit", *words[k + 1 :]]) for k in rng.permutation(300)[:150]]
    assert [r.doc_id for r in simhash.near_duplicates(frame(spark, crowd)).collect()] == [0]


def slow_groups(texts, similarity=0.8):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= similarity * len(x | sets[j]) and label[i] != label[j]:
                label = [min(label[i], label[j]) if v in (label[i], label[j]) else v for v in label]
    return label


def test_near_duplicates_against_all_pairs(spark):
    """Scattered edits, cuts and added blocks at similarities from just 0.8."""
    rng, texts = np.random.default_rng(4), []
    for t in range(60):
        base = [f"t{t}w{k}" for k in rng.integers(0, 5000, 250)]
        kind, share = t % 3, 0.8 + 0.003 * (t // 3)
        if kind == 0:
            edits = rng.choice(250, max(1, int(250 * (1 - share) / 10)), replace=False)
            copy = ["edit" if k in edits else w for k, w in enumerate(base)]
        else:
            copy = base[: int(250 * share) + 1] if kind == 1 else [*base, *(f"t{t}new{k}" for k in range(int(250 / share) - 252))]
        texts += [" ".join(base), " ".join(copy)]
    want = sorted(set(slow_groups(texts)))
    assert len(want) <= 62
    assert sorted(r.doc_id for r in simhash.near_duplicates(frame(spark, texts)).collect()) == want


def test_near_duplicates_takes_the_components_of_fingerprints(spark, monkeypatch):
    """Without any band of minima, the similar pairs within a component of fingerprints are the links."""
    rng, line, texts = np.random.default_rng(13), "one line that all of these texts repeat often ", []
    for t in range(12):
        base = [f"t{t}w{k}" for k in rng.integers(0, 5000, 300)]
        for edits in (0, 1, 3, 25):
            texts.append(" ".join("edit" if k < edits else w for k, w in enumerate(base)))
        # Prints that the line decides, over words that differ.
        texts.append(line * 120 + " ".join(base))
    prints = [slow_fingerprint(t) for t in texts]
    met = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if met(i, j):
                part = [min(part[i], part[j]) if v in (part[i], part[j]) else v for v in part]
    want = set()
    for p in set(part):
        members = [i for i, v in enumerate(part) if v == p]
        want |= {members[v] for v in slow_groups([texts[i] for i in members])}
    monkeypatch.setattr(simhash, "band_keys", lambda kinds: [])
    got = {r.doc_id for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    # More similar pairs may be met on the way, none that brute force doesn't find.
    assert set(slow_groups(texts)) <= got <= want and len(set(part)) < len(want) < len(texts) - 12


def test_near_duplicates_sends_and_writes_texts_once(spark):
    """Texts that meet no other are written in one table and sent in one shuffle before the result."""
    rng = np.random.default_rng(14)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 40, 2000)) for _ in range(200)]
    docs, folder = simhash.save(frame(spark, texts), "once"), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    written = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/lakemill/*/*.parquet"))
    size, before = sum(map(len, texts)), (sent(), written())
    assert simhash.near_duplicates(docs).count() == 200
    assert sent() - before[0] < 1.5 * size and written() - before[1] < 0.8 * size


def test_near_duplicates_under_one_repeated_line(spark):
    """A line in all texts outweighs their own words, by which alone they are alike or not."""
    rng, line = np.random.default_rng(6), "one line that all of these texts repeat often "
    texts = []
    for t in range(7):
        own = [f"t{t}own{k}" for k in range(300)]
        for _ in range(3):
            texts.append(line * 120 + " ".join("edit" if k == rng.integers(300) else w for k, w in enumerate(own)))
    got = sorted(r.doc_id for r in simhash.near_duplicates(frame(spark, texts)).collect())
    assert got == sorted(set(slow_groups(texts))) and len(got) == 7


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, LARGER).collect()
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert ones and zeros
    assert np.mean([[a > b for b in zeros] for a in ones]) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_token_file(spark, rows):
    tk, start = Tokenizer.from_file(rans.default_vocabulary()), 0
    got = {r.doc_id: r for r in queries.op6_token_file(spark, SF).collect()}
    for i in sorted(rows):
        ids = [*tk.encode(rows[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_piece_encoder_on_odd_text():
    import random

    e, rng = rans.PieceEncoder(rans.default_vocabulary()), random.Random(1)
    samples = ["İ, x", "a<|endoftext|>b <|ENDOFTEXT|>", "'sword ('S don't", "́abc क़, ≮", "日本語。 ΣΑΣ"]
    samples += ["".join(rng.choice("aBé'İ.,!<|>x9 \t́Σñ- 日") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for s in samples:
        assert e.encode([s.encode()])[0].tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids, s


def test_pieces_of_many_texts_at_once(monkeypatch):
    """Batches, long pieces, texts cut into stretches and a table that has to be cleared."""
    e, rng = rans.PieceEncoder(rans.default_vocabulary()), np.random.default_rng(9)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 9))) + "!,"[: rng.integers(0, 3)] for _ in range(400)) for _ in range(20)]
    texts += ["", "z" * 300, "a " + "long" * 90 + " b", "Ü" * 70 + " end"]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for stretch, places in ((runs.STRETCH, rans.PLACES), (100, rans.PLACES), (5000, 1 << 12)):
        monkeypatch.setattr(runs, "STRETCH", stretch)
        monkeypatch.setattr(rans, "STRETCH", stretch)
        monkeypatch.setattr(rans, "PLACES", places)
        monkeypatch.setattr(rans, "PLACE_BITS", places.bit_length() - 1)
        e.table.clear()
        assert [x.tolist() for x in e.encode([t.encode() for t in texts])] == want


def test_token_file_is_in_order(spark, rows):
    folder = rans.new_folder(spark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rans.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), rans.default_vocabulary(), folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    blocks = folder.removeprefix("file://") + "/blocks"
    table = rans.Table(np.frombuffer(spark.read.parquet(f"{folder}/table").first()["freq"], "<u4").astype(np.int64))
    found = [x for f in sorted(glob.glob(f"{blocks}/part-*.parquet")) for r in pq_file.read_table(f).column("record").to_pylist() for x in rans.unpack_block(r, table)]
    assert [x[0] for x in found] == sorted(rows)
    assert [x[1] for x in found] == np.cumsum([0, *(len(x[2]) for x in found[:-1])]).tolist()


def test_damaged_block_is_refused():
    ids = np.random.default_rng(0).integers(0, 50, 5000).astype(np.uint32)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=50)))
    record = rans.pack_block(7, [(1, ids[:3000]), (None, ids[3000:])], table)
    assert [(k, at, x.tolist()) for k, at, x in rans.unpack_block(record, table)] == [(1, 7, ids[:3000].tolist()), (None, 3007, ids[3000:].tolist())]
    with pytest.raises(ValueError):
        list(rans.unpack_block(record[:-1] + bytes([record[-1] ^ 1]), table))


def test_vector_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64))
    x = np.concatenate([base[k] + rng.standard_normal((30, 64)) * 0.22 for k in range(40)])
    data = [(k, [float(v) for v in row], int(k % 2)) for k, row in enumerate(x)]
    data += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] * 64, 1), (5003, [1.0] * 64, None), (5004, [], 0)]
    got = {r.vec_id: r for r in pq.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    want = near.sum(1) - 1
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() > 0
    assert all(got[k].n_links == 0 and got[k].kept for k in range(5000, 5005))


def test_line_dedup(spark):
    passage = "\n".join(f"shared line {k}" for k in range(40))
    long = " ".join(f"licence{k}" for k in range(60))
    texts = [f"own a\n{passage}\nown b", f"own c\n{passage}\nown d", f"{long}\nown e", f"own f\n{long}", None, "", "own a\nown g"]
    got = {r.doc_id: r.text for r in linededup.line_dedup(frame(spark, texts)).collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and got[3] == "own f" and got[4] is None and got[5] == "" and got[6] == texts[6]
    assert got[1] == "own c\nown d"


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 8, 10])
def test_line_dedup_of_passages_of_any_number_of_lines(spark, size):
    """Passages of 60 words in 1 to 10 lines among unrelated lines go as a whole, and nothing else does."""
    texts = []
    for k in range(20):
        words = [f"p{k}w{j}" for j in range(60)]
        passage = "\n".join(" ".join(words[j * 60 // size : (j + 1) * 60 // size]) for j in range(size))
        texts += [f"own {k} first\n{passage}\nown {k} second", f"other {k}\nmore {k} lines\n{passage}\nand {k} more"]
    got = {r.doc_id: r.text for r in linededup.line_dedup(frame(spark, texts)).collect()}
    for k in range(20):
        assert got[2 * k] == texts[2 * k] and got[2 * k + 1] == f"other {k}\nmore {k} lines\nand {k} more"


def test_bpe(spark, rows):
    tk = Tokenizer.from_file(bpe.default_vocabulary())
    tk.no_padding()
    tk.no_truncation()
    for r in queries.op9_bpe_codec(spark, SF).collect():
        ids = tk.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    table = bpe.rank_table(bpe.default_vocabulary())
    for t in ["a<|endoftext|>b", "  two  spaces ", "\n\n x", "don't 'S 12,345!", "日本語 é́", "z" * 5000]:
        ids = tk.encode(t, add_special_tokens=False).ids
        assert table.encode(t) == np.array(ids, "<u4").tobytes() and table.decode(table.encode(t)) == t


def slow_alignment(item, passage):
    best, above = 0, [0] * (len(passage) + 1)
    for a in item:
        row = [0]
        for k, b in enumerate(passage):
            row.append(max(0, above[k] + (2 if a == b else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(item))


def test_alignment_against_cells():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, passage = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(-1, 5, rng.integers(1, 30))
        assert abs(decontam.align(item, passage)[0] - slow_alignment(item.tolist(), passage.tolist())) < 1e-9


def test_decontamination(spark):
    item = "what is the name of the tall grey tower that stands beside the old harbour of the northern town"
    words = item.split()
    edited = " ".join([*words[:5], "very", *words[5:12], *words[13:]])
    texts = [f"intro text {item} and more", f"some {edited} more", "clean text about towers and harbours", None, ""]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    found = decontam.contaminated(frame(spark, texts), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 1), (1, 1)]
    assert sorted(r.doc_id for r in decontam.decontaminate(frame(spark, texts), bench).collect()) == [2, 3, 4]


@pytest.mark.parametrize("copies,clean", [(1, 4), (1, 200), (6, 1000), (60, 240)])
def test_edited_copies_are_all_met(spark, copies, clean):
    """Every fifth word is replaced: most four-word runs of the item occur nowhere."""
    item = [f"item{k}" for k in range(38)]
    leak = " ".join("other" if k % 5 == 4 else w for k, w in enumerate(item))
    texts = [f"before {leak} after {k}" for k in range(copies)] + [f"clean text {k} about item{k % 38} item{k % 38 + 1}" for k in range(clean)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontam.contaminated(frame(spark, texts), bench).collect()
    assert sorted(r.doc_id for r in found) == list(range(copies))
    assert all(abs(r.score - slow_alignment(item, texts[r.doc_id].split())) < 1e-9 for r in found)


def test_decontamination_against_every_alignment(spark):
    """All items with all texts, the copies edited at random; a pair must keep four words in a row."""
    rng = np.random.default_rng(11)
    draw = lambda n: [f"w{k}" for k in rng.zipf(1.3, n) % 300]
    items = [draw(int(n)) for n in rng.integers(3, 40, 12)]
    texts = []
    for _ in range(80):
        body = draw(int(rng.integers(5, 60)))
        copy = [w if rng.random() > 0.12 else "edit" for w in items[int(rng.integers(12))] if rng.random() > 0.05]
        texts.append([*body[:9], *copy, *body[9:]] if rng.random() < 0.6 else body)
    want = set()
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            if {*decontam.grams(x, 4)} & {g for n in (3, 4) for g in zip(*(t[j:] for j in range(n)))} and slow_alignment(x, t) >= decontam.MIN_SCORE:
                want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = decontam.contaminated(frame(spark, [" ".join(t) for t in texts]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 20


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    docs = frame(spark, ODD).withColumn("label", F.lit(1)).withColumn("hash", F.lit("x"))
    docs = docs.unionAll(docs.where("doc_id = 3"))
    docs = docs.limit(0) if empty else docs
    spark.createDataFrame([(1, "a b c d e"), (2, None)], "item_id long, text string").limit(0 if empty else 2).write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        assert out.count() <= docs.count()


@pytest.mark.parametrize("empty", [False, True])
def test_operators_on_odd_rows(spark, empty):
    docs = frame(spark, ODD).withColumn("text_crc32", F.lit(1)).withColumn("size", F.lit(2))
    docs = docs.limit(0) if empty else docs
    n = 0 if empty else len(ODD)
    labels = spark.createDataFrame([(0, None), (1, 1), (3, 0)], "doc_id long, toxic int")
    assert lmscore.score_texts(docs, F.lit(True)).count() == n
    assert langid.identify(docs, langid.train(docs, F.lit(True))).count() == n
    assert kdshard.kd_shards(docs, shards=4).count() == n
    assert simhash.simhash_components(docs).count() == n
    assert toxicity.toxicity(docs, toxicity.train(docs, labels, F.lit(True))).count() == n
    folder = rans.new_folder(spark)
    rans.write_tokens(docs, rans.default_vocabulary(), folder)
    assert rans.read_tokens(spark, folder).count() == n
    assert pq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_pipeline_keeps_clean_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in out.limit(20).collect():
        assert len(r.ids) % 4 == 0 and bpe.rank_table(bpe.default_vocabulary()).decode(bytes(r.ids)) == r.decoded
