"""The keyed permutation of ``masking.permuted`` for a column of ASCII values, all values of one shape at a time.

Equal to the expression in ``masking``, which takes the values that are NULL here: those with other characters, with more
than ``most`` letters and digits, or of a shape that few values of a batch have.  A round's hash depends on the shape, the
round and one half, so for halves of at most ``TABLE`` values a worker keeps them and hashes each only once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

TABLE = 1 << 18
MOST_KEPT = 1 << 23  # entries of all tables of a worker, 64 MB
FEW = 4  # values of a shape that are not worth a batch of their own

RADIX, FIRST, FORM = np.ones(256, np.int64), np.zeros(256, np.int64), np.arange(256, dtype=np.uint8)
for low, high, radix in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)):
    RADIX[ord(low) : ord(high) + 1], FIRST[ord(low) : ord(high) + 1], FORM[ord(low) : ord(high) + 1] = radix, ord(low), ord(low)

_tables: dict[bytes, np.ndarray] = {}


def _hashes(prefix: bytes, halves: np.ndarray) -> np.ndarray:
    """60 bits of the hash of each half behind the prefix."""
    start = hashlib.sha256(prefix)
    out = np.empty(len(halves), np.int64)
    for i, half in enumerate(halves.tolist()):
        h = start.copy()
        h.update(b"%d" % half)
        out[i] = int.from_bytes(h.digest()[:8], "big") >> 4
    return out


def _round(prefix: bytes, halves: np.ndarray, size: int) -> np.ndarray:
    if size > TABLE:
        values, where = np.unique(halves, return_inverse=True)
        return _hashes(prefix, values)[where]
    table = _tables.get(prefix)
    if table is None:
        if sum(map(len, _tables.values())) + size > MOST_KEPT:
            _tables.clear()
        table = _tables[prefix] = np.full(size, -1, np.int64)
    found = table[halves]
    if (found < 0).any():
        missing = np.unique(halves[found < 0])
        table[missing] = _hashes(prefix, missing)
        found = table[halves]
    return found


def _number(digits: np.ndarray, radix: np.ndarray) -> tuple[np.ndarray, int]:
    n, size = np.zeros(len(digits), np.int64), 1
    for j, r in enumerate(radix.tolist()):
        n, size = n * r + digits[:, j], size * r
    return n, size


def _digits(n: np.ndarray, radix: np.ndarray) -> np.ndarray:
    out = np.empty((len(n), len(radix)), np.int64)
    for j in range(len(radix) - 1, -1, -1):
        n, out[:, j] = np.divmod(n, radix[j])
    return out


def permute(values: pa.Array, secret: bytes, rounds: int, most: int) -> pa.Array:
    """Masks of the values; ``secret`` is what each hash begins with."""
    values = values.cast(pa.string())
    n = len(values)
    if not n or values.null_count == n:
        return pa.nulls(n, pa.string())
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at = (ends - ends[0]).astype(np.int32)
    out = data.copy()
    forms = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(FORM[data])]).dictionary_encode()
    which = forms.indices.to_numpy()
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(forms.dictionary) + 1))
    done = np.zeros(n, bool)
    for k, form in enumerate(forms.dictionary.to_pylist()):
        rows = order[cuts[k] : cuts[k + 1]]
        shape = np.frombuffer(form, np.uint8)
        places = np.flatnonzero(RADIX[shape] > 1)
        if len(rows) < FEW or len(places) > most or (shape > 127).any():
            continue
        done[rows] = True
        if not len(places):
            continue
        cells = at[rows][:, None] + places
        radix, first, cut = RADIX[shape[places]], FIRST[shape[places]], -(-len(places) // 2)
        digits = data[cells] - first
        (a, ra), (b, rb) = _number(digits[:, :cut], radix[:cut]), _number(digits[:, cut:], radix[cut:])
        for turn in range(1, rounds + 1):
            prefix = secret + b"%d:%s%d:" % (len(form), form, turn)
            a, b, ra, rb = b, (a + _round(prefix, b, rb) % ra) % ra, rb, ra
        if rounds % 2:
            raise ValueError("an even number of rounds puts the halves back in their places")
        out[cells] = np.concatenate((_digits(a, radix[:cut]), _digits(b, radix[cut:])), 1) + first
    done &= values.is_valid().to_numpy(zero_copy_only=False)
    return pa.Array.from_buffers(pa.string(), n, [pa.py_buffer(np.packbits(done, bitorder="little")), pa.py_buffer(at), pa.py_buffer(out)])
