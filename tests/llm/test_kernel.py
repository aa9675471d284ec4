import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import kernel, langid, warc, wavelet
from quillon.llm.shared import member, pack, positions, unpack

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab C,.\n\té一\x0b0"), max_size=40)), max_size=8)


@given(TEXTS, st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_words_match_the_patterns(texts, limit):
    for separators, fold, pattern in ((kernel.SPACES, None, WORDS), (kernel.PUNCTUATION, kernel.LOWER, PLAIN)):
        seen = {}
        for low, high, data, offsets in kernel.chunks(pa.array(texts, pa.string()), limit):
            w = kernel.split_words(data, offsets, separators, fold)
            for d in range(high - low):
                seen[low + d] = [w.data[a:b].tobytes() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
        for i, t in enumerate(texts):
            body = (t or "").encode()
            assert seen[i] == pattern.findall(body.lower() if fold is not None else body)


def test_grams_stay_within_documents_and_depend_on_words_alone():
    texts = pa.array(["a b c d", None, "x  a\tb\nc d", "a b"])
    (_, _, data, offsets), *rest = kernel.chunks(texts)
    assert not rest
    w = kernel.split_words(data, offsets)
    h, at = kernel.grams(w.hashes(), w.first, 3)
    assert list(at - np.repeat(w.first[:-1], [2, 0, 3, 0])) == [0, 1, 0, 1, 2]
    assert h[0] == h[3] and h[1] == h[4] and len(set(h)) == 3


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=200), st.integers(8, 20))
@settings(max_examples=50, deadline=None)
def test_packed_positions_come_back(values, bits):
    hashes = np.array(values, np.uint64)
    bitmap = np.zeros(1 << bits, bool)
    for s, block in positions(bits, [hashes]):
        bitmap[s * (1 << bits) // 64 + np.cumsum(unpack(block)[0].astype(np.int64))] = True
    packed = np.packbits(bitmap)
    assert member(packed, hashes, bits).all()
    assert bitmap.sum() == len({v >> (64 - bits) for v in values})


def test_pack_keeps_types():
    a, b = np.arange(5, dtype=np.uint16), np.linspace(0, 1, 5)
    x, y = unpack(pack(a, b))
    assert x.dtype == a.dtype and (x == a).all() and (y == b).all()


@given(st.lists(st.lists(st.integers(0, 70_000), max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_wavelet_round_trip_and_queries(documents):
    ids = np.array([x for d in documents for x in d], np.uint32)
    data = wavelet.encode(ids, list(range(len(documents))), [len(d) for d in documents])
    f = wavelet.WaveletFile(lambda offset, size: data[offset : offset + size])
    assert f.tokens().tolist() == ids.tolist() and f.lengths == [len(d) for d in documents]
    for i in range(0, len(ids), 7):
        assert f.access(i) == ids[i]
    for t in {*ids[:5].tolist(), 3, 99_999}:
        places = np.flatnonzero(ids == t).tolist()
        assert f.count(t) == len(places)
        assert f.count(t, 2, max(2, len(ids) - 1)) == sum(2 <= p < max(2, len(ids) - 1) for p in places)
        assert [f.occurrence(t, k) for k in range(len(places) + 1)] == [*places, -1]


def test_wavelet_over_several_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    ids = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint16)
    data = wavelet.encode(ids, [1], [1000])
    f = wavelet.WaveletFile(lambda offset, size: data[offset : offset + size])
    assert f.tokens().tolist() == ids.tolist()
    assert [f.access(i) for i in range(0, 1000, 37)] == ids[::37].tolist()
    places = np.flatnonzero(ids == 7)
    assert [f.occurrence(7, k) for k in range(len(places))] == places.tolist()


def test_bundle_seeks_one_frame(tmp_path):
    path = tmp_path / "x.warc.zst"
    writer = warc.Writer(path.open("wb"), 2000)
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>".encode() * 50, None if i % 3 else i + 1) for i in range(40)] + [(None, None, b"", None)]
    names = []
    for p in pages:
        name, data = warc.record(*p)
        names.append(name)
        writer.add(name, data)
    writer.close()
    bundle = warc.Bundle(pa.OSFile(str(path)))
    assert len(bundle.frames) > 5
    reads = []
    read = bundle._read
    bundle._read = lambda offset, size: reads.append(size) or read(offset, size)
    fields, payload = bundle.record(names[7])
    assert payload == pages[7][2] and fields["X-Page-ID"] == "7" and len(reads) == 2
    got = list(bundle.records())
    assert [f["X-Page-ID"] for f, _ in got] == [*(str(i) for i in range(40)), ""]
    assert [p for _, p in got] == [b"" if r is not None else x for _, _, x, r in pages]
    with pytest.raises(ValueError):
        warc.Bundle(pa.BufferReader(b"\0" * 64))


def phrases(text: str, sample: str) -> int:
    """Greedy longest matches, at least one symbol each."""
    n, i = 0, 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        i += max(1, k)
        n += 1
    return n


@given(st.text("abc ", max_size=60), st.lists(st.text("abcd ", max_size=40), max_size=4), st.sampled_from([1, 2, 3, 7, 512]))
@settings(max_examples=150, deadline=None)
def test_cross_parsing_counts_longest_matches(sample, texts, segment):
    model = langid.Model({"x": sample.encode(), "y": b"dddd"})
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    whole, langid.SEGMENT = langid.SEGMENT, segment
    try:
        got = model.phrases(np.frombuffer(raw, np.uint8), offsets)
    finally:
        langid.SEGMENT = whole
    for row, t in zip(got, texts, strict=True):
        # a phrase may begin with an unknown symbol, which stands alone
        assert row[0] == phrases(t, sample) and row[1] == phrases(t, "dddd")


def test_cross_parsing_of_long_texts():
    rng = np.random.default_rng(8)
    sample = "".join(rng.choice(list("abcde "), 6000))
    texts = [sample, sample[100:4200], "".join(rng.choice(list("abcdef "), 5000)), sample[:3000] + "f" + sample[2000:], "a" * 3000, ""]
    model = langid.Model({"x": sample.encode(), "y": b"a" * 900})
    got = model.phrases(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    for row, t in zip(got, texts, strict=True):
        assert row.tolist() == [phrases(t, sample), phrases(t, "a" * 900)]
    assert got[0][0] == got[1][0] == 1 and got[4][1] == 4


def test_symbols_fold_and_squeeze():
    texts = ["AÉÑ 12,  b", "", "  "]
    raw = "".join(texts).encode()
    x, at = langid.symbols(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    assert [x[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == ["aéñ b", "", " "]


def test_crc_is_of_little_endian_words():
    from quillon.llm.tokens import crc

    assert crc(np.array([1, 70_000], np.uint32)) == zlib.crc32(b"\x01\0\0\0\x70\x11\x01\0")
