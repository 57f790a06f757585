import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from helpers import check_sql, empty, odd

from rasterbrook.llm import media

rng = np.random.default_rng(7)
PAYLOADS = [b"", b"\x80" * 700, bytes(range(256)) * 9, rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), b"\0" * 4096, b"a" * 4097, (b"\x80" * 40 + b"\x01") * 60, b"\xff" * 500]


def test_exact_round_trip_of_any_bytes():
    payloads = [media.pad(p) for p in PAYLOADS]
    files = media.store(payloads)
    assert [p for p, _ in media.load(files)] == payloads
    assert files == [media.store([p])[0] for p in payloads]  # whatever stands beside it


def test_bands_change_nothing(monkeypatch):
    payloads = [media.pad(p) for p in PAYLOADS]
    files = media.store(payloads)
    read = media.load(files)
    for band in (1, 3, 7):
        monkeypatch.setattr(media, "BAND", band)
        assert media.store(payloads) == files and media.load(files) == read


def test_a_long_text_s_memory_is_bounded():
    """Sixteen times the text, at most, in a process of its own."""
    code = "import resource; from rasterbrook.llm import media; m = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss << 10; media.load(media.store([b'warm up ' * 8])); a = m(); p = media.pad(b'some words of a long text ' * 640_000); assert media.load(media.store([p]))[0][0] == p; print((m() - a) / len(p))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(out.stdout) < 16


def test_frames_decode_alike_bit_by_bit():
    """Against a plain decoder that takes one bit at a time."""
    frames, _, _ = media.riff_index(media.store([media.pad(PAYLOADS[3][:3000])])[0])
    for frame, (coefficients, _) in zip(frames, media.decode_frames(frames), strict=True):
        rows = len(coefficients) // media.GRID
        data = frame[len(media.frame_header(rows)) : -2]
        parts, at = [bytearray()], 0
        while at < len(data):
            if data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7:
                parts.append(bytearray())
                at += 2
            else:
                parts[-1].append(data[at])
                at += 2 if data[at] == 0xFF else 1
        tables = [{v: k for k, v in t[2].items()} for t in (media.dc_table(), media.ac_table())]
        plain = []
        for part in parts:
            bits = iter("".join(f"{b:08b}" for b in part))

            def symbol(table, bits=bits):
                code, n = 0, 0
                while (code, n) not in table or not n:
                    code, n = code << 1 | int(next(bits)), n + 1
                return table[code, n]

            def value(s, bits=bits):
                x = int("".join(next(bits) for _ in range(s)) or "0", 2)
                return x if not s or x >> (s - 1) else x - (1 << s) + 1

            dc = 0
            for _ in range(media.GRID):
                block = [0] * 64
                dc += value(symbol(tables[0]))
                block[0], k = dc, 1
                while k < 64:
                    rs = symbol(tables[1])
                    if rs == 0:
                        break
                    k += rs >> 4
                    if rs & 15:
                        block[k] = value(rs & 15)
                    k += 1
                plain.append(block)
        assert coefficients.tolist() == plain


def test_pixels_are_the_definition():
    c = rng.integers(-128, 128, (3, 64)).astype(np.int16)
    got = media.pixels(c, np.ones(64, np.float32))
    for i in range(3):
        natural = np.zeros(64)
        natural[media.zigzag()] = c[i]
        u = np.arange(8)
        a = np.array([[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in u] for k in u])
        want = np.clip(np.rint(a.T @ natural.reshape(8, 8) @ a + 128), 0, 255)
        assert np.abs(got[i].reshape(8, 8) - want).max() <= 1


def test_shots_are_cut_where_histograms_jump():
    still, other = np.r_[np.zeros(15), 100], np.r_[100, np.zeros(15)]
    assert media.shots(np.array([still] * 5 + [other] * 4 + [still])) == [(0, 5), (5, 9), (9, 10)]
    assert media.shots(np.array([still])) == [(0, 1)]


def test_broken_files_raise():
    good = media.store([media.pad(b"some text " * 100)])[0]
    for bad in (b"", good[:40], good.replace(b"00dc", b"00xx", 1)):
        with pytest.raises((ValueError, IndexError, Exception)):
            assert media.load([bad])[0][0] == media.pad(b"some text " * 100)


def expected(rows):
    out = []
    for r in rows:
        raw = (r.text or "").encode()
        payload = media.pad(raw)
        file = media.store([payload])[0]
        out.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]


def test_whole_table(spark, tiny_dir):
    rows = media.query(spark, tiny_dir).collect()
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in rows), key=repr) == expected(docs)
    assert all(r.feature for r in rows)


PAYLOAD_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, length(h) // 2 AS n, rpad(h, CAST(greatest(1, (length(h) + 127) // 128) * 128 AS INT), '0') AS h FROM h)
SELECT doc_id, n AS n_bytes, length(h) // 2 AS payload_bytes, sha256(unhex(h)) AS payload_sha256 FROM p
"""


def test_payloads_against_sql(spark, sf_dir):
    check_sql(spark, lambda spark, sf_dir: media.query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256"), PAYLOAD_SQL, sf_dir, ["documents"])


def test_odd_rows_and_empty(spark):
    read = media.read_media(media.store_texts(odd(spark)))
    docs = {(d.doc_id, media.pad((d.text or "").encode())) for d in odd(spark).collect()}
    assert {(r.doc_id, bytes(r.payload)) for r in read.collect()} == docs
    clips = media.clip_rows(read).collect()
    assert len(clips) >= read.count() and all(c.end_s > c.start_s for c in clips)
    assert media.read_media(media.store_texts(empty(spark))).collect() == []
