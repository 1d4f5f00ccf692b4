import hashlib
import random
import zlib

import numpy as np

from tidemark.llm import jpeg, media


def test_round_trip_of_any_bytes():
    rnd = random.Random(4)
    payloads = [bytes(rnd.randrange(256) for _ in range(192 * n)) for n in (1, 2, 7, 513)] + [b"\0" * 384, b"\xff" * 960, b" " * 192 * 5000]
    stored = jpeg.encode(payloads)
    read, images = jpeg.decode(stored)
    assert read == payloads
    assert all(x.dtype == np.uint8 and x.shape[2] == 3 for own in images for x in own)
    assert len(images[-1]) == 2 and images[0][0].shape == (8, 8, 3)


def test_markers_and_scans():
    [m] = jpeg.encode([b"a" * 192])
    assert m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9" and b"\xff\xc2" in m and m.count(b"\xff\xda") == len(jpeg.SCANS)


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def data(self):
        text = self.text + "1" * (-len(self.text) % 8)
        raw = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
        return raw.replace(b"\xff", b"\xff\0")


def _scalar_image(coefs, w, h, samp):
    """A slow, general progressive writer: runs of zeros, end-of-band runs, new coefficients in refinements."""
    symbols = sorted({r << 4 | s for r in range(16) for s in range(11)})
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)  # every code has 8 bits
    code = {s: i for i, s in enumerate(symbols)}
    comps = [(1, samp, 0), (2, (1, 1), 0), (3, (1, 1), 0)]
    seg = jpeg._segment
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(1, 65)))
    out += seg(0xC2, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3]) + b"".join(bytes([i, s[0] << 4 | s[1], q]) for i, s, q in comps))
    out += seg(0xC4, b"\x00" + table + b"\x10" + table)

    def signed(v, s):
        return v if v > 0 else v + (1 << s) - 1

    across, down = -(-w // (8 * samp[0])), -(-h // (8 * samp[1]))
    own = [(-(-w // 8), -(-h // 8)), (-(-w // (8 * samp[0])), -(-h // (8 * samp[1]))), (-(-w // (8 * samp[0])), -(-h // (8 * samp[1])))]
    for low, first in ((1, True), (0, False)):
        b, pred = Bits(), [0, 0, 0]
        for my in range(down):
            for mx in range(across):
                for c, (_, s, _) in enumerate(comps):
                    for y in range(s[1]):
                        for x in range(s[0]):
                            v = int(coefs[c][my * s[1] + y, mx * s[0] + x, 0])
                            if first:
                                d = (v >> 1) - pred[c]
                                pred[c] = v >> 1
                                n = abs(d).bit_length()
                                b.put(code[n], 8)
                                b.put(signed(d, n) if n else 0, n)
                            else:
                                b.put(v & 1, 1)
        out += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, (0 if first else 1) << 4 | low])) + b.data()
    for c in range(3):
        b, run = Bits(), 0

        def flush():
            nonlocal run
            while run:
                n = run.bit_length() - 1
                b.put(code[n << 4], 8)
                b.put(run - (1 << n), n)
                run -= 1 << n

        blocks = [coefs[c][y, x] for y in range(own[c][1]) for x in range(own[c][0])]
        for blk in blocks:
            zeros = 0
            for k in range(1, 64):
                v = int(abs(blk[k])) >> 1
                if not v:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    b.put(code[0xF0], 8)
                    zeros -= 16
                n = v.bit_length()
                b.put(code[zeros << 4 | n], 8)
                b.put(signed(v if blk[k] > 0 else -v, n), n)
                zeros = 0
            run += zeros > 0
        flush()
        out += seg(0xDA, bytes([1, c + 1, 0, 1, 63, 1])) + b.data()
        b, run = Bits(), 0
        for blk in blocks:
            mags = [int(abs(v)) for v in blk]
            new = [k for k in range(1, 64) if mags[k] == 1]
            last, zeros, pending = (max(new) if new else 0), 0, ""
            for k in range(1, last + 1):
                if mags[k] > 1:
                    pending += str(mags[k] & 1)
                elif mags[k] == 1:
                    b.put(code[zeros << 4 | 1], 8)
                    b.put(int(blk[k] > 0), 1)
                    b.text += pending
                    zeros, pending = 0, ""
                else:
                    zeros += 1
                    if zeros == 16:
                        b.put(code[0xF0], 8)
                        b.text += pending
                        zeros, pending = 0, ""
            if last < 63:
                b.put(code[0], 8)
                b.text += pending + "".join(str(mags[k] & 1) for k in range(last + 1, 64) if mags[k] > 1)
        out += seg(0xDA, bytes([1, c + 1, 0, 1, 63, 1 << 4])) + b.data()
    return out + b"\xff\xd9", [np.array([x for row in co for x in row]) for co in coefs]


def test_general_images_with_subsampled_chroma():
    rng = np.random.default_rng(1)
    for samp, w, h in (((2, 2), 40, 24), ((1, 1), 16, 8), ((2, 1), 33, 9)):
        across, down = -(-w // (8 * samp[0])), -(-h // (8 * samp[1]))
        coefs = [np.where(rng.random((down * s[1], across * s[0], 64)) < 0.15, rng.integers(-9, 10, (down * s[1], across * s[0], 64)), 0) for s in (samp, (1, 1), (1, 1))]
        for c, own in zip(coefs, [(-(-w // 8), -(-h // 8))] * 1 + [(across, down)] * 2):
            c[own[1] :, :, 1:] = 0
            c[:, own[0] :, 1:] = 0
        image, want = _scalar_image(coefs, w, h, samp)
        reader = jpeg.Coefficients([image, image])
        got = reader.decode()
        assert (got == np.concatenate([*want, *want])).all()
        _, [[rgb], _] = jpeg.decode([image, image])
        assert rgb.shape == (h, w, 3)


def test_transform_is_the_inverse_cosine():
    rng = np.random.default_rng(2)
    coefs = rng.integers(-60, 60, (5, 64))
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    natural = np.zeros((5, 64))
    natural[:, jpeg.ZIGZAG] = coefs
    exact = np.clip(np.einsum("ux,nuv,vy->nxy", basis, natural.reshape(5, 8, 8), basis) + 128, 0, 255)
    assert np.abs(jpeg.samples(coefs, np.ones(64, np.int64)).reshape(5, 8, 8) - exact).max() <= 1


def test_every_row(docs, rows, nothing):
    found = {r.doc_id: r for r in media.documents_as_media(docs).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        p, r = media.payload(text), found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    one = [r for r in found.values() if r.payload_sha256 == found[3 if rows[3][1] else 4].payload_sha256]
    assert len({(r.media_sha256, r.feature) for r in one}) == 1
    assert media.documents_as_media(nothing).count() == 0


def test_tensors(docs):
    stored = media.store_media(docs.where("doc_id < 4"))
    assert all(len(r.rgb) == 3 * r.height * r.width for r in media.decode_media(stored).collect())
