"""Secret scans: fixed shapes, and high-entropy strings found with a sliding window.

Candidates are runs of token characters; a path is cut into its segments. Over a candidate slides a window; the counts of its characters are
kept up to date as one character enters and one leaves, and with them the Shannon entropy. Where it
reaches the limit of the candidate's character class, the window's stretch is a finding; touching stretches
become one span. Each class has the limit that 99.5 % of random strings of its alphabet reach in one window, so
that with the allow list 98 % of random keys of 20 characters are found, and more of longer ones. The allow list
takes out what is random-looking but public or made of words: a candidate is cut, at separators and changes of case, into segments, and if those
whose letter pairs are those of language hold half of its letters, only the stretches between them are searched, each by itself.

Defined cases: a null or empty text has no spans. Positions are code points, the end exclusive. Rows are
scanned alone, so repeated rows repeat their result. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waybridge.llm.common import batched, per_batch, record_batch

#: Fixed shapes, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower_digit", "entropy_upper_digit",
         "entropy_one_case", "entropy_two_case")
_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
#: Character class: windows, and the bits per character that make them findings. Those of 20 characters are the 0.5 %
#: quantiles, rounded down, of 60,000 random strings of [0-9a-f], [A-Za-z0-9], [a-z0-9], [A-Z2-7], [a-z] and [A-Za-z].
LIMITS = {
    "entropy_hex": ((20, 2.82), (24, 3.2)), "entropy_base64": ((20, 3.58),), "entropy_lower_digit": ((20, 3.34),),
    "entropy_upper_digit": ((20, 3.28),), "entropy_one_case": ((20, 3.16),), "entropy_two_case": ((20, 3.52),)}
LEAST = 20
#: Share of frequent letter pairs from which a run may be words, and from which an identifier of several names is taken for one.
USUAL, USUAL_SNAKE = 0.45, 0.3
#: Allow list: public identifiers, and runs made of plain words and numbers.
_UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_BETWEEN = re.compile(rb"[+/_=-]+")
_SEGMENT = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: A path's segment: names of one case or with a capital, with numbers around and between.
_NAME = rb"[0-9]*+(?:[A-Z]?+[a-z]++|[A-Z]++)?+[0-9]*+(?:[A-Z]?+[a-z]++|[A-Z]++)?+[0-9]*+"
_PATH = re.compile(rb"[+_=-]*+%b(?:[+_=-]++%b)*+" % (_NAME, _NAME))
#: Identifiers of several names joined by underscores.
_SNAKE = re.compile(rb"_*+[A-Za-z]++[0-9]*+(?:_++[A-Za-z0-9]++)++_*+")
_LETTERS = re.compile(rb"[A-Za-z]+")
#: Frequent letter pairs of English, German, French and Spanish: a fifth of all pairs, most of those in words.
_PAIRS = frozenset(
    b"th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur "
    b"ch ie ei un ge ic ht sc be au ne em us nn ss el li di so me ma ri ro co io la lo om ac ca il ta tr ec ce na mi no pe "
    b"po qu ue ai ir ns pa pr su ll ad do da os nc ci ot ut ab ag ef eh ft ig ke kt rt ru rs ts tz uf um zu ho fo fe fi wa "
    b"we wo ow ly ay".split())
_DIGEST_BEFORE = re.compile(rb"(md5|sha-?(1|224|256|384|512)|checksum|integrity|commit|etag)[\"']?\s*[-:= ]\s*[\"']?$", re.I)

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_HEX_ONLY = re.compile(rb"[0-9a-f]+|[0-9A-F]+")

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64())])


def runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(member.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def entropy_stretches(data: bytes, window: int, limit: float) -> list[tuple[int, int]]:
    """Stretches covered by windows of at least ``limit`` bits per character.

    With counts c of the window's characters, H = log2(w) - sum(c * log2(c)) / w; the sum changes by two
    terms when the window moves.
    """
    if len(data) < window:
        return []
    # a window holds one more character for a moment, between one entering and one leaving
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts = [0] * 256
    total = 0.0
    most = (math.log2(window) - limit) * window + 1e-9
    found: list[list[int]] = []
    for i, x in enumerate(data):
        c = counts[x]
        total += term[c + 1] - term[c]
        counts[x] = c + 1
        if i >= window:
            gone = data[i - window]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
        if i >= window - 1 and total <= most:
            if found and found[-1][1] >= i - window + 1:
                found[-1][1] = i + 1
            else:
                found.append([i - window + 1, i + 1])
    return [(a, b) for a, b in found]


def spoken(part: bytes) -> bool:
    """Whether half of the letter pairs of a part are frequent in language, or half are steps along the alphabet."""
    if len(part) < 4 or not _LETTERS.fullmatch(part):
        return False
    low = part.lower()
    n = len(low) - 1
    return (2 * sum(low[i:i + 2] in _PAIRS for i in range(n)) >= n
            or 2 * sum(abs(low[i + 1] - low[i]) == 1 for i in range(n)) >= n)


def words(run: bytes) -> list[tuple[int, int]] | None:
    """Places of a run's words, if these hold half of its letters and digits and its letter pairs are those of language; else None.

    Names of up to three letters between separators tell nothing either way.
    """
    found, spelled, chars, pairs, usual, at = [], 0, 0, 0, 0, 0
    for sep in [*_BETWEEN.finditer(run), None]:
        end = sep.start() if sep else len(run)
        inside = end - at
        for m in _SEGMENT.finditer(run, at, end):
            segment = m.group().lower()
            inside -= len(segment) if len(segment) < 4 and len(segment) == end - at else 0
            pairs += len(segment) - 1
            usual += sum(segment[i:i + 2] in _PAIRS or abs(segment[i + 1] - segment[i]) == 1 for i in range(len(segment) - 1))
            if spoken(segment):
                found.append(m.span())
                spelled += len(segment)
        chars += inside
        at = sep.end() if sep else end
    if 2 * spelled >= chars and usual >= USUAL * pairs:
        return found
    return [(0, len(run))] if _SNAKE.fullmatch(run) and usual >= USUAL_SNAKE * pairs else None


def path_segments(run: bytes) -> list[tuple[int, int]]:
    """The segments of a path, else the whole run."""
    if run.count(b"/") < 2:
        return [(0, len(run))]
    ends = [m.start() for m in re.finditer(rb"/", run)] + [len(run)]
    cuts = list(zip([0, *[e + 1 for e in ends[:-1]]], ends))
    return cuts if all(_PATH.fullmatch(run, a, b) for a, b in cuts) else [(0, len(run))]


def allowed(data: bytes, start: int, end: int) -> bool:
    """Whether a candidate is a public identifier."""
    return bool(_UUID.fullmatch(data[start:end].strip(b"-_=/+")) or _DIGEST_BEFORE.search(data[max(0, start - 40):start]))


def char_class(run: bytes) -> str | None:
    """The class of a run by its letters and digits; digits with one letter at most have none."""
    plain = run.translate(None, b"+/_=-")
    letters = plain.translate(None, b"0123456789")
    if len(letters) < 2:
        return None
    digits = len(letters) < len(plain)
    if digits and _HEX_ONLY.fullmatch(plain):
        return "entropy_hex"
    if letters.islower() or letters.isupper():
        return "entropy_one_case" if not digits else "entropy_lower_digit" if letters.islower() else "entropy_upper_digit"
    return "entropy_base64" if digits else "entropy_two_case"


def stretch_entropy(run: bytes) -> tuple[str | None, list[tuple[int, int]]]:
    """Class of a stretch without words, and where in it the entropy is high.

    Keys of mixed case use separators as characters; in the other classes these group a key and are left out.
    """
    kind = char_class(run)
    if kind is None:
        return None, []
    found = []
    for as_characters in (True, False):
        if kind not in ("entropy_base64", "entropy_two_case") if as_characters else kind == "entropy_base64":
            continue
        keep = [i for i in range(len(run)) if as_characters or run[i] not in b"+/_=-"]
        kept = bytes(run[i] for i in keep)
        found += [(keep[a], keep[b - 1] + 1) for w, limit in LIMITS[kind] for a, b in entropy_stretches(kept, w, limit)]
    found.sort()
    joined: list[list[int]] = []
    for a, b in found:
        if joined and joined[-1][1] >= a:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return kind, [(a, b) for a, b in joined]


def high_entropy(run: bytes) -> list[tuple[str, int, int]]:
    """Classes and places of high entropy in a candidate."""
    out = []
    for first, last in path_segments(run):
        places = words(run[first:last])
        cuts = [(0, 0), *(places or []), (last - first, last - first)]
        for (_, a), (b, _) in zip(cuts[:-1], cuts[1:]):
            if b - a >= LEAST:
                kind, found = stretch_entropy(run[first + a:first + b])
                out += [(kind, first + a + x, first + a + y) for x, y in found]
    return out


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    spans = []
    low = data.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if b"AKIA" in data:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_CHARS]
    codes = np.frombuffer(data, np.uint8)
    candidates = runs(_TOKEN[codes], LEAST)
    for start, end in candidates:
        spans += [(start + a, 2, start + b) for a, b in runs(_HEX[codes[start:end]], HEX_CHARS)]
    base = list(spans)
    for start, end in candidates:
        if allowed(data, start, end):
            continue
        for kind, a, b in high_entropy(data[start:end]):
            a, b = start + a, start + b
            if not any(s <= a and b <= e for s, _, e in base):
                spans.append((a, KINDS.index(kind), b))
    return sorted(spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Counts per fixed shape, digest of the fixed spans, and all spans of every text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, joined = [], [], []
        for data in batch.column("text").fill_null("").cast(pa.binary()).to_pylist():
            spans = scan(data)
            if spans and not data.isascii():
                point = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                at = lambda b: int(point[b - 1]) if b else 0
                spans = [(at(s), k, at(e)) for s, k, e in spans]
            said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
            base = ",".join(x for x, (_, k, _) in zip(said, spans) if k < 3)
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            joined.append(",".join(said))
            kinds = [k for _, k, _ in spans]
            counts.append([kinds.count(0), kinds.count(1), kinds.count(2), sum(k > 2 for k in kinds)])
        c = np.array(counts, np.int64)
        return record_batch(SCHEMA, {
            "doc_id": batch.column("doc_id"), "n_assign": c[:, 0], "n_access": c[:, 1], "n_hex": c[:, 2],
            "base_sha256": digests, "spans": joined, "n_entropy": c[:, 3]})

    return batched(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")).mapInArrow(
        per_batch(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                        "spans string, n_entropy long")
