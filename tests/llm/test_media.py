import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from marlstone.llm import media


def png(width=2):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.txt", "world")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


def test_types_and_carving():
    s = media.Sniffer()
    assert s.sniff(png(), "image/jpeg") == ("image/png", True, [])
    assert s.sniff(media.wav(b"abc"), "audio/wav") == ("audio/wav", False, [])
    assert s.sniff(GIF, None)[0] == "image/gif"
    assert s.sniff(archive(), None) == ("application/zip", True, [])
    assert s.sniff(gzip.compress(b"x" * 99), None)[0] == "application/gzip"
    data = b"noise GIF89a \x89PNG\r\n\x1a\n" + png() + b"--" + GIF + archive()
    kind, corrected, inner = s.sniff(data, "text/plain")
    assert kind == media.UNKNOWN and corrected
    assert [(data[o : o + n], t) for o, n, t in inner] == [(png(), "image/png"), (GIF, "image/gif"), (archive(), "application/zip")]


def test_damaged_files_are_not_found():
    s = media.Sniffer()
    assert s.media(png()[:-3]) == []
    assert s.media(png().replace(b"IDAT", b"IDAX")) == []
    assert s.media(media.wav(b"abcd")[:-1]) == []
    assert s.media(b"") == []


def test_documents(spark, docs_of):
    rows = [(1, "é" * 400), (2, None), (3, ""), (4, "x" * 576), (4, "x" * 576), (5, "y" * 577)]
    out = {(r["doc_id"]): r for r in media.digest_media(media.store_texts(docs_of(rows))).collect()}
    for i, text in rows:
        data = (text or "").encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.wav(padded)), hashlib.sha256(media.wav(padded)).hexdigest())
        assert r["feature"].startswith("type=audio/wav;")
    assert media.digest_media(media.store_texts(docs_of([]))).count() == 0


def test_carve_column(spark):
    df = spark.createDataFrame([(1, bytearray(b"__" + png())), (2, None)], "id bigint, media binary")
    assert [tuple(r) for r in media.carve(df, "id").collect()] == [(1, 2, "image/png", bytearray(png()))]


def crc(data, polynomial, bits):
    out = 0
    for byte in data:
        out ^= byte << bits - 8
        for _ in range(8):
            out = (out << 1 ^ (polynomial if out >> bits - 1 else 0)) & (1 << bits) - 1
    return out


def flac(frames=3, block=40):
    info = struct.pack(">HH", block, block) + b"\0" * 6 + ((8000 << 44) | (7 << 36) | frames * block).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC\x80" + len(info).to_bytes(3, "big") + info
    for i in range(frames):
        head = b"\xff\xf8\x60\x02" + bytes([i, block - 1])
        head += bytes([crc(head, 0x07, 8)])
        frame = head + b"\0" + bytes([60 + i])
        out += frame + struct.pack(">H", crc(frame, 0x8005, 16))
    return out


def tiff():
    strip, ifd = b"\x80" * 9, 8
    entries = [(256, 3, 1, 3), (257, 3, 1, 3), (273, 4, 1, 100), (279, 4, 1, len(strip)), (282, 5, 1, 70)]
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
    return (b"II*\0" + struct.pack("<I", ifd) + body).ljust(100, b"\0") + strip


def test_lengths_are_confirmed():
    s = media.Sniffer()
    for data, kind in ((flac(), "audio/flac"), (tiff(), "image/tiff")):
        assert s.media(b"__" + data + b"behind it") == [(2, len(data), kind)]
        assert s.media(data[:-3]) == []


def test_media_inside_media_of_the_same_format():
    s = media.Sniffer()
    inner = media.wav(b"1234")
    assert s.media(media.wav(b"ab" + inner)) == [(0, len(media.wav(b"ab" + inner)), "audio/wav"), (46, len(inner), "audio/wav")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("inner.zip", archive())
    whole = out.getvalue()
    assert s.media(whole) == [(0, len(whole), "application/zip"), (whole.index(archive()), len(archive()), "application/zip")]


def test_time_in_proportion_to_length():
    import time

    s, began = media.Sniffer(), time.time()
    for part in (b"%PDF-1 ", b"PK\x03\x04", b"\x1f\x8b\x08", b"%PDF-1 startxref ", b"\xff\xd8\xff"):
        assert s.media(part * 150_000) == []
    assert time.time() - began < 20


def test_a_long_text(spark, docs_of):
    text = "RIFF %PDF-1 é" * 300_000
    r = media.digest_media(media.store_texts(docs_of([(1, text)]))).first()
    assert r["n_bytes"] == len(text.encode()) and r["feature"].endswith("embedded=")
