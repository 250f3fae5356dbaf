"""Bytes of small recording files."""

import struct

import numpy as np

from trialweave.sources import recordings as rec


def encode_recording(samples: list, cut: bool) -> bytes:
    """A recording with 2 amplifier, 2 ADC and 1 digital channel from rows (a0, a1, adc0, adc1, word)."""

    def text(value: str) -> bytes:
        raw = value.encode("utf-16-le")
        return struct.pack("<I", len(raw)) + raw

    out = struct.pack("<Ihhf", rec.MAGIC, 2, 0, 2000.0) + struct.pack("<hffffff", 1, 1, 1, 7500, 1, 1, 7500)
    out += struct.pack("<hff", 2, 1000.0, 1000.0) + text("") * 3 + struct.pack("<hh", 0, 1) + text("ref")
    channels = [("A-000", 0, 0), ("A-001", 1, 0), ("ANALOG-0", 0, 3), ("ANALOG-1", 1, 3), ("DIN-05", 5, 4)]
    out += struct.pack("<h", 1) + text("Port A") + text("A") + struct.pack("<hhh", 1, len(channels), 2)
    for name, order, kind in channels:
        out += text(name) + text(name)
        out += struct.pack(rec.CHANNEL_RECORD, order, order, kind, 1, order, 0, 0, 0, 0, 0, 1e5 * (order + 1), 10.0)
    table = np.array(samples, dtype=np.int64).reshape(-1, 5)
    n_blocks = -(-len(table) // 128)
    padded = np.zeros((n_blocks * 128, 5), dtype=np.int64)
    padded[: len(table)] = table
    blocks = np.zeros(n_blocks, dtype=rec.block_type(rec.parse_header(out)))
    shaped = padded.reshape(n_blocks, 128, 5).transpose(0, 2, 1)
    blocks["timestamp"] = np.arange(n_blocks * 128).reshape(n_blocks, 1, 128)
    blocks["amplifier"], blocks["adc"], blocks["digital_in"] = shaped[:, :2], shaped[:, 2:4], shaped[:, 4:]
    out += blocks.tobytes()
    return out[:-1] if cut else out
