"""Recording headers and sample files as bytes. No Spark here."""

import re
from dataclasses import dataclass

import numpy as np

#: Fixed values of the recording format: gain where none is given, rate where none is given.
GAIN, RATE = 200.0, 250.0
#: Sample formats of whole bytes as (numpy type, what is subtracted, value of a missing sample).
WHOLE = {
    "16": ("<i2", 0, -(1 << 15)),
    "32": ("<i4", 0, -(1 << 31)),
    "61": (">i2", 0, -(1 << 15)),
    "80": ("u1", 1 << 7, -(1 << 7)),
    "160": ("<u2", 1 << 15, -(1 << 15)),
}
#: Bytes for a sample, and the value of a missing one, of formats that pack or pad.
PACKED = {"24": (3.0, -(1 << 23)), "212": (1.5, -(1 << 11))}
_STORED = re.compile(r"(\d+)(?:x(\d+))?(?::(\d+))?(?:\+(\d+))?$")
_SCALE = re.compile(r"([-+0-9.eE]+)(?:\(([-+]?\d+)\))?(?:/.*)?$")


class Unreadable(ValueError):
    """A recording that cannot be decoded; the text says why."""


@dataclass(frozen=True)
class Lead:
    """What a header says of one lead: its file, how samples are stored there, and their scale."""

    file: str
    kind: str
    per_frame: int
    offset: int
    gain: float
    baseline: int
    name: str


@dataclass(frozen=True)
class Header:
    rate: float
    samples: int | None
    leads: list[Lead]


def _lead(line: str) -> Lead:
    words = line.split(maxsplit=8)
    stored = _STORED.match(words[1]) if len(words) > 1 else None
    if stored is None:
        raise Unreadable("a lead line cannot be read")
    kind, per_frame, skew, offset = stored.groups()
    if kind not in WHOLE and kind not in PACKED:
        raise Unreadable(f"format {kind} is not read")
    if int(skew or 0):
        raise Unreadable("skewed leads")
    if "/" in words[0] or "\\" in words[0] or words[0] in ("~", ".", ".."):
        raise Unreadable("the sample file is not in the header's folder")
    zero = int(words[4]) if len(words) > 4 and re.fullmatch(r"[-+]?\d+", words[4]) else 0
    scale = _SCALE.match(words[2]) if len(words) > 2 else None
    try:
        gain = float(scale[1]) if scale else 0.0
    except ValueError:
        gain = 0.0
    base = int(scale[2]) if scale and scale[2] else zero
    return Lead(words[0], kind, int(per_frame or 1) or 1, int(offset or 0), gain or GAIN, base, words[8].strip() if len(words) > 8 else "")


def read_header(text: str) -> Header:
    """The first line that is neither blank nor a comment tells leads, rate and samples; the next ones a lead each."""
    lines = [s.strip() for s in text.removeprefix("\ufeff").splitlines()]
    lines = [s for s in lines if s and not s.startswith("#")]
    words = lines[0].split() if lines else []
    if len(words) < 2 or not words[1].isdigit():
        raise Unreadable("the header's first line cannot be read")
    if "/" in words[0]:
        raise Unreadable("a record of several segments")
    n = int(words[1])
    if len(lines) <= n:
        raise Unreadable("the header has fewer lead lines than leads")
    rate = re.match(r"[0-9.]+", words[2]) if len(words) > 2 else None
    samples = int(words[3]) if len(words) > 3 and words[3].isdigit() else None
    return Header(float(rate[0]) if rate else RATE, samples or None, [_lead(s) for s in lines[1 : n + 1]])


def samples_of(kind: str, raw: bytes) -> tuple[np.ndarray, int]:
    """Whole samples, as numbers, and the value that means a missing one."""
    if kind in WHOLE:
        of, less, missing = WHOLE[kind]
        width = np.dtype(of).itemsize
        return np.frombuffer(raw[: len(raw) // width * width], dtype=of).astype(np.int64) - less, missing
    width, missing = PACKED[kind]
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    if kind == "24":
        data = data[: len(data) // 3 * 3].reshape(-1, 3)
        x = data[:, 0] | data[:, 1] << 8 | data[:, 2] << 16
        return np.where(x >= 1 << 23, x - (1 << 24), x), missing
    n = int(len(data) / width)  # two samples of 12 bits in three bytes; a last one may stand in two
    data = np.concatenate([data, np.zeros(-len(data) % 3, dtype=np.int64)]).reshape(-1, 3)
    x = np.stack([data[:, 0] | (data[:, 1] & 15) << 8, data[:, 2] | (data[:, 1] >> 4) << 8], axis=1).ravel()[:n]
    return np.where(x >= 1 << 11, x - (1 << 12), x), missing


def decode(header: Header, files: dict[str, bytes]) -> np.ndarray:
    """float64, leads by samples, in physical units; missing samples are NaN. Leads that share a file are interleaved in it.

    A lead with several samples in a frame becomes their mean. With a number of samples in the header, what follows is left out.
    """
    if not header.leads:
        raise Unreadable("no leads")
    out: list[np.ndarray] = []
    for k, first in enumerate(header.leads):
        if k and first.file == header.leads[k - 1].file:
            continue
        group = [first]
        for lead in header.leads[k + 1 :]:
            if lead.file != first.file:
                break
            group.append(lead)
        if any(lead.kind != first.kind for lead in group):
            raise Unreadable("leads of one file have different formats")
        x, missing = samples_of(first.kind, files[first.file][first.offset :])
        frame = sum(lead.per_frame for lead in group)
        x = x[: len(x) // frame * frame].reshape(-1, frame).astype(np.float64)
        x[x == missing] = np.nan
        at = 0
        for lead in group:
            part = x[:, at : at + lead.per_frame].mean(axis=1)
            out.append((part - lead.baseline) / lead.gain)
            at += lead.per_frame
    n = header.samples if header.samples is not None else len(out[0])
    if header.samples is not None and min(map(len, out)) < n:
        raise Unreadable("a sample file is shorter than the header says")
    out = [x[:n] for x in out] if header.samples is not None else out
    if any(len(x) != n for x in out):
        raise Unreadable("leads of different lengths")
    return np.stack(out)
