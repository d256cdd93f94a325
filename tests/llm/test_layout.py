import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendgrid.llm import media, mixing, packing, sharding, token_blocks
from spendgrid.llm.tokenize import Encoder

from . import helpers as H

tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    "", "  two  spaces ", " lead", "trail ", "a \n b\n\n c", "don't they'll I'm x's.", "<|endoftext|> and a<|endoftext|>b", "ümläut, ÉCOLE. œuvre ÿ ª º µ", "tab\tx \t y", "中文 字 🎉 a", "nb sp  x", "12 3.4,5 a1.", "é é́ x.",
    "İ I. ß", "line one.\nLine two, three.\nfour", "x.\n", "word, word. word word,", "a  b", "  x", "ﬁ ǆ Ⅷ",
]


@pytest.mark.parametrize(("file", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(file, keeps):
    e = Encoder(tokenizers.path(file), keeps)
    for _ in range(2):  # the second time from memory
        ids, per = e.encode(pa.array([*TEXTS, None]))
        at = np.r_[0, np.cumsum(per)]
        for i, t in enumerate(TEXTS):
            assert ids[at[i] : at[i + 1]].tolist() == e.whole.encode(t, add_special_tokens=False).ids, t
        assert per[-1] == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.,'\n\t 1中<|>s ́", max_size=40))
def test_encoder_on_odd_spacing(text):
    for file, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = _cached(file, keeps)
        assert e.encode(pa.array([text]))[0].tolist() == e.whole.encode(text, add_special_tokens=False).ids


_made = {}


def _cached(file, keeps):
    if file not in _made:
        _made[file] = Encoder(tokenizers.path(file), keeps)
    return _made[file]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.floats(0.01, 1.0))
def test_blocks_round_trip(ids, share):
    raw = token_blocks.pack(np.array(ids, np.uint32), share)
    assert token_blocks.unpack(raw).tolist() == ids
    assert token_blocks.unpack(raw, 1, 3).tolist() == ids[128:384]


def test_blocks_are_smaller_than_plain_ids():
    ids = np.random.default_rng(1).integers(0, 4000, 100_000).astype(np.uint32)
    ids[::500] = 2**31
    assert len(token_blocks.pack(ids)) < 0.45 * ids.nbytes


def test_token_files_in_key_order(spark):
    docs = H.awkward(spark).withColumn("start", media.F.lit("clash"))
    files = token_blocks.token_segments(docs, tokenizers.path("byte_bpe_50k.json"), segment_ids=2000)
    rows = token_blocks.read_tokens(files).collect()
    e = _cached("byte_bpe_50k.json", True)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    rows = sorted(rows, key=lambda r: r.start)
    at = 0
    for r, ((known, key), text) in zip(rows, want, strict=True):
        ids = np.array([*e.whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id == (key if known else None), r.start, r.n_tokens) == (True, at, len(ids))
        assert bytes(r.ids) == ids.tobytes() and r.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert token_blocks.read_tokens(token_blocks.token_segments(H.documents(spark, []), tokenizers.path("byte_bpe_50k.json"))).count() == 0


def _best_fit(counts, capacity):
    """How many sequences best-fit decreasing opens, one piece at a time."""
    rooms = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is None:
            rooms.append(capacity - length)
        else:
            rooms[rooms.index(fit)] = fit - length
    return len(rooms)


def _planned(counts, capacity):
    bins, placed = {}, {}
    for length, rank, n, first, offset, stack in packing.plan_slots(counts, capacity).tolist():
        assert rank == placed.get(length, 0)
        placed[length] = rank + n
        for k in range(n):
            bins.setdefault(first + k // stack, []).append((offset + k % stack * length, length))
    assert placed == counts
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=20))
def test_plan_slots_is_best_fit(counts):
    assert _planned(counts, 41) == _best_fit(counts, 41)


def test_plan_slots_of_many_histograms_and_large_counts():
    assert _planned({1164: 4, 3984: 11, 916: 11}, 4096) == _best_fit({1164: 4, 3984: 11, 916: 11}, 4096)
    r = random.Random(8)
    for _ in range(3000):
        counts = {r.randint(1, 4095) if r.random() < 0.7 else r.randint(1, 300): r.randint(1, 12) for _ in range(r.randint(1, 12))}
        assert _planned(counts, 4096) == _best_fit(counts, 4096), counts
    assert len(packing.plan_slots({k: 10**12 + k for k in range(1, 4096)}, 4096)) < 20_000  # the plan's size does not follow the counts


def test_packing_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("offset", media.F.lit(1))
    rows = packing.pack_documents(docs, tokenizers.path("word_bpe_49k.json"), capacity=512).collect()
    bins, by = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and 0 < r.length <= 512
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault(r.doc_id, []).append(r)
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 512
    assert [r.length for r in by[1]] == [1] and len(by[9]) == 2 and len(by[6]) > 100
    assert all(r.length == 512 for r in by[6] if r.piece < len(by[6]) - 1)
    assert packing.pack_documents(H.documents(spark, []), tokenizers.path("word_bpe_49k.json")).count() == 0


def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(3000)] + [(5000 + i, "hot " * 50) for i in range(1500)]
    out = sharding.histogram_shards(H.documents(spark, rows).withColumn("slot", media.F.lit("clash"))).collect()
    assert len(out) == len(rows)
    size = np.zeros(24)
    slots = {}
    for r in out:
        size[r.shard] += len(r.text) + 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert 0.9 <= size.min() / size.mean() and size.max() / size.mean() <= 1.1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for r in out:
        homes.setdefault(r.text, set()).add(r.shard)
    assert len(homes["hot " * 50]) > 5 and sum(len(h) > 1 for h in homes.values()) <= 3


def test_shards_of_awkward_rows(spark):
    docs = H.awkward(spark)
    out = sharding.histogram_shards(docs).collect()
    assert len(out) == docs.count() and {r.shard for r in out} <= set(range(24))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    ties = [(r.shard, r.slot) for r in out if r.doc_id == 9]
    assert len(set(ties)) == 2 and len({s for s, _ in ties}) == 1  # repeated rows lie together, each in its own slot
    assert sharding.histogram_shards(H.documents(spark, [])).count() == 0


def _targets(sizes, share=1.5, cap=2.0):
    """The law as told: share by weight, cut at the cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(out.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


def test_source_targets(spark):
    for sizes in ({"a": 100, "b": 900, "c": 10, None: 50}, {"z": 5}, {"é": 3, "e": 1000, "f": 1000, "": 7, "g": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = _targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mixture_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), None, f"s{i % 4}" if i % 5 else None) for i in range(4000)]
    docs = H.documents(spark, rows)
    plan = mixing.mix_plan(docs).collect()
    assert plan == mixing.mix_plan(docs.repartition(7)).orderBy("doc_id").collect() or {r.doc_id: r.copies for r in plan} == {r.doc_id: r.copies for r in mixing.mix_plan(docs.repartition(7)).collect()}
    taken, target = {}, {}
    for r in plan:
        assert r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.08 * target[s] for s in target)
    assert mixing.mix(docs).count() == sum(r.copies for r in plan) and mixing.mix(docs).columns == docs.columns


def test_mixing_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("size", media.F.lit("clash"))
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.size for r in rows}[3] == 0
    assert mixing.mix_plan(H.documents(spark, [])).count() == 0 and mixing.mix(H.documents(spark, [])).count() == 0


def test_telephony_codecs():
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        # fixed points of G.711: silence, extremes, signs
        assert media.MULAW[0xFF] == 0 and media.MULAW[0x00] == -32124 and media.MULAW[0x80] == 32124
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and media.ALAW[0xAA] == 32256 and media.ALAW[0x2A] == -32256
    for code in range(256):  # G.711 in whole numbers, code by code
        c = code ^ 0xFF
        assert media.MULAW[code] == (-1 if c & 128 else 1) * 4 * ((2 * (c & 15) + 33 << (c >> 4 & 7)) - 33)
        c, e = code ^ 0x55, (code ^ 0x55) >> 4 & 7
        assert media.ALAW[code] == (1 if c & 128 else -1) * 8 * (2 * (c & 15) + 1 if e == 0 else 2 * (c & 15) + 33 << e - 1)
    assert len(media.ADPCM_STEPS) == 89


def _adpcm_by_hand(block):
    """One IMA ADPCM block, nibble by nibble."""
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.ADPCM_STEPS[index])
            d = step >> 3
            d += step if n & 4 else 0
            d += step >> 1 if n & 2 else 0
            d += step >> 2 if n & 1 else 0
            sample = max(-32768, min(32767, sample - d if n & 8 else sample + d))
            index = max(0, min(88, index + int(media.ADPCM_MOVES[n & 7])))
            out.append(sample)
    return out


def test_adpcm_blocks_against_one_by_one():
    raw = np.random.default_rng(3).integers(0, 256, (50, 64)).astype(np.uint8)
    got = media.decode_adpcm(raw)
    assert got.tolist() == [_adpcm_by_hand(bytes(b)) for b in raw]


def test_audio_is_stored_without_loss(spark):
    import hashlib

    docs = H.awkward(spark).withColumn("media", media.F.lit("clash"))
    for codec in ("mulaw", "alaw", "adpcm"):
        sound = media.store_sound(media.store_audio(docs, codec))
        got = {(r.doc_id, r.n_bytes): r for r in media.audio_features(sound).collect()}
        kept = {(r.doc_id, r.n_bytes): bytes(r.pcm) for r in media.pcm_of(sound).collect()}
        assert len(got) == docs.distinct().count() and sound.count() == docs.count()
        for r in docs.collect():
            b = (r.text or "").encode()
            p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
            g = got[r.doc_id, len(b)]
            assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            f = media.wav(p, codec)
            assert (g.media_bytes, g.media_sha256) == (len(f), hashlib.sha256(f).hexdigest())
            if len(p) > 10_000:
                continue
            # sound and features, sample by sample
            parts = []
            for c in ("mulaw", "alaw", "adpcm"):
                flat = [x for k in range(0, len(p), 64) for x in _adpcm_by_hand(p[k : k + 64])] if c == "adpcm" else [int({"mulaw": media.MULAW, "alaw": media.ALAW}[c][x]) for x in p]
                pcm = [v for x, y in zip(flat, [*flat[1:], flat[-1]], strict=True) for v in (x, (x + y) // 2)]
                parts.append(f"{c}:{max(map(abs, pcm))},{sum(map(abs, pcm))},{sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:], strict=False))}")
                if c == codec:
                    assert kept[r.doc_id, len(b)] == np.array(pcm, "<i2").tobytes()
            assert g.feature == ";".join(parts)
    r = media.decode_audio(media.store_audio(docs.where("doc_id = 10"))).first()
    pcm = media.resample(media.expand(np.frombuffer("Ünïcödé ß 中文 🎉".encode().ljust(64, b"\0"), np.uint8), "mulaw"))
    assert bytes(r.pcm) == pcm.astype("<i2").tobytes() and r.pcm_rate == 16000
    assert media.decode_audio(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect() == [(1, None, None, None)]
    assert json.dumps(media.audio_features(media.store_sound(media.store_audio(H.documents(spark, [])))).collect()) == "[]"


def test_pcm_codes_come_back_whole():
    """Files on their lines take half the room; any others come back as well, wrapped differences too."""
    rng = np.random.default_rng(8)
    for up in (1, 2, 3):
        size = np.array([1, 4, 0, 30, 64]) * up
        wild = rng.integers(-32768, 32768, size.sum()).astype(np.int16)
        line = media.resample(wild[: size.sum() // up], up, size // up)
        for pcm in (wild, line, np.where(np.arange(len(line)) % 50 == 49, -line, line).astype(np.int16)):
            codes = media.pack_pcm(pcm, size, up)
            assert np.array_equal(np.concatenate([media.unpack_pcm(c) for c in codes]), pcm)
        assert sum(map(len, media.pack_pcm(line, size, up))) == 2 * size.sum() // up + 2 * len(size)


def test_letters_that_stay_are_learnt_without_translation():
    class Counted(dict):
        asked = 0

        def __getitem__(self, c):
            Counted.asked += 1
            return super().__getitem__(c)

    enc = Encoder(tokenizers.path("byte_bpe_50k.json"), True)
    enc.latin = Counted(enc.latin)
    texts = ["Plain words only and more plain Words", "words again words", "one. two, three\nfour", "", "Plain"]
    for texts in (texts, texts[::-1]):
        ids, per = enc.encode(pa.array(texts))
        want = [enc.whole.encode(x, add_special_tokens=False).ids for x in texts]
        assert per.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]
    assert Counted.asked == 0
    texts = ["straße Ünïcödé word", "mehr straße ªº µm", "naïve, 中文 déjà."]
    ids, per = enc.encode(pa.array(texts))
    assert ids.tolist() == [k for x in texts for k in enc.whole.encode(x, add_special_tokens=False).ids] and Counted.asked > 0
