import random

import pytest

from bindery.functions import binary as B


@pytest.mark.parametrize("step", [40, 1 << 16])
def test_palmdoc_batches(step, monkeypatch):
    monkeypatch.setattr(B, "STEP", step)
    monkeypatch.setattr(B, "LONG", 4 * step)
    draw = random.Random(7)
    parts = [bytes(draw.choices(kind, k=n)) for kind in (range(256), b"ab \x01\x80", b"a") for n in (0, 1, 2, 3, 4, 13, 64, 500)]
    codes = B.palmdoc_compress_all(parts)
    assert [B.palmdoc_decompress(x) for x in codes] == parts and B.palmdoc_decompress_all(codes) == parts
    for x in parts:  # any bytes as codes: the same text, or the same error, as byte by byte
        try:
            wanted = B.palmdoc_decompress(x)
        except ValueError:
            with pytest.raises(ValueError):
                B.palmdoc_decompress_all([b"abc", x])
        else:
            assert B.palmdoc_decompress_all([b"abc", x, b"q"]) == [b"abc", wanted, b"q"]
