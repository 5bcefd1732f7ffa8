"""Writes small recordings and annotation files for tests."""

import numpy as np


def recording(labels, rate, seconds, data, record_sec=1, unit="uV", cut=0, declared=None):
    ns = len(labels)
    pad = lambda v, n: str(v).ljust(n).encode()
    need = 256 + 256 * ns
    head = pad("0", 8) + pad("X", 80) + pad("X", 80) + b"01.01.24" + b"10.00.00"
    head += pad(declared or need, 8) + pad("", 44) + pad(seconds // record_sec, 8) + pad(record_sec, 8) + pad(ns, 4)
    head += b"".join(pad(x, 16) for x in labels) + pad("", 80) * ns + pad(unit, 8) * ns
    head += pad("-3276.8", 8) * ns + pad("3276.7", 8) * ns + pad("-32768", 8) * ns + pad("32767", 8) * ns
    head += pad("", 80) * ns + pad(rate * record_sec, 8) * ns + pad("", 32) * ns
    body = np.round(np.asarray(data) * 10).astype("<i2").reshape(ns, -1, rate * record_sec)
    out = head + body.swapaxes(0, 1).tobytes()
    return out[: len(out) - cut] if cut else out
