"""Plain versions of the operators that SQL cannot express."""

import hashlib
from collections import Counter


def repeated_bytes(rows, length=200):
    """{(index): (n_bytes, n_removed, n_spans, sha)} of texts, by counting every string of the given length."""
    datas = [(t or "").encode() for t in rows]
    seen = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out
