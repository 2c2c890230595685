"""Secret scan with dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and long hexadecimal runs. The method looks at
every other token of 16 or more key characters that starts within ``REACH`` characters after a
sensitive word or ends within ``REACH`` before one, and at the tokens that only dots, or a line
break with white space and quotes around it, part from such a token: the lines of a key block,
the parts of a signed token. A candidate's novelty is its marginal size: bytes of the
compressed surrounding text with the candidate less the bytes without it, where the
compressor is primed with a dictionary of identifiers and the surrounding text itself comes
first. Words, paths and names that the dictionary or the surroundings hold cost a few bytes;
random strings cost about as many bits as their alphabet needs. The candidate itself is blanked out of
its surroundings, so that a secret that a file repeats is reported at each place. A candidate that mixes
character classes and costs ``MIN_BITS`` or more per character is reported as ``novelty``.

Offsets are code points, ends exclusive. A null text is empty. A null id passes through.
Repeated rows each give a row.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novelty")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as shorter ones are dropped
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|"
                       r"credential|client[_ -]?id|authorization|bearer", re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("pass", "secret", "token", "key", "credential", "client", "authorization", "bearer")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
JOINT = re.compile(r"\.+|[\x20\t\"'+,\\]*\r?\n[\x20\t\"'+]*")  # a run of tokens goes on behind it
REACH = 64       # characters after a sensitive word in which a candidate starts, or before one in which it ends
AROUND = 1024    # characters of surrounding text on each side
MIN_BITS = 5.5   # marginal bits per byte; random strings cost 6 to 8, known words 1 to 5

IDENTIFIERS = (
    "password passwd passphrase secret secrets token tokens api_key apikey access_key access_token refresh_token "
    "private_key public_key client_id client_secret credential credentials authorization bearer basic username user "
    "user_name login account email host hostname port database connection connection_string config configuration "
    "settings environment environ getenv process.env os.environ default required optional example placeholder your "
    "changeme undefined null None true false string number boolean integer object array list dictionary function "
    "return import from class public static void private protected const let var self this request response headers "
    "content-type application/json accept encoding utf-8 session cookie expires max-age signature algorithm "
    "authentication authorization_code grant_type redirect_uri https://www. http://localhost .example.com /api/v1/ "
    "/usr/local/bin/ /home/ /etc/ .config .json .yaml .html validate verify generate create update delete insert "
    "select where encrypt decrypt hash digest base64 decode encode rotate manager service provider factory handler "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ---------------- ================ "
    "________________ xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX")


class Novelty:
    """Marginal compressed bits of a candidate."""

    def __init__(self, identifiers: str):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False,
                                                                write_dict_id=False)
        self._zstd = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)

    def bits(self, text: str, start: int, end: int) -> float:
        """Bits per byte that text[start:end] adds after its surroundings and the dictionary."""
        own = text[start:end]
        around = "\n".join(part.replace(own, " ") for part in (text[max(0, start - AROUND):start], text[end:end + AROUND]))
        around, candidate = around.encode(errors="replace"), own.encode(errors="replace")
        grown = len(self._zstd.compress(around + b"\n" + candidate)) - len(self._zstd.compress(around + b"\n"))
        return 8 * grown / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    spans = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _near(text: str) -> set[tuple[int, int]]:
    """Tokens near sensitive words, and the runs that they stand in. Of a token that holds a
    sensitive word, the part on each side of the word counts as a token."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    out, picked = set(), set()
    for word in SENSITIVE.finditer(text):
        first = bisect.bisect_left(ends, word.start() - REACH)
        for k in range(first, bisect.bisect_left(starts, word.end() + REACH)):
            s, e = tokens[k]
            if e <= word.start() or s >= word.end():
                picked.add(k)
            else:
                out |= {m.span() for part in ((s, word.start()), (word.end(), e)) for m in TOKEN.finditer(text, *part)}
    joined = [JOINT.fullmatch(text, e, s) is not None for e, s in zip(ends, starts[1:])]
    run = 0  # the first token of the run
    for k in range(len(tokens)):
        if k + 1 == len(tokens) or not joined[k]:
            if any(i in picked for i in range(run, k + 1)):
                picked.update(range(run, k + 1))
            run = k + 1
    return out | {tokens[k] for k in picked}


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, min_bits: float) -> list[tuple[int, int, int]]:
    """Candidates near sensitive words that no base span touches and that don't compress."""
    low = text.lower()
    if not any(word in low for word in SENSITIVE_WORDS):
        return []
    found = {}
    for start, end in _near(text):
        token = text[start:end]
        classes = (any(c.isdigit() for c in token) + any("a" <= c <= "z" for c in token)
                   + any("A" <= c <= "Z" for c in token))
        if classes >= 2 and not any(s < end and start < e for s, _, e in base):
            found[start, end] = novelty.bits(text, start, end) >= min_bits
    return sorted((s, 3, e) for (s, e), is_novel in found.items() if is_novel)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch], identifiers: str, min_bits: float) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(identifiers)
    for batch in batches:
        spans, digests = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
            spans.append(sorted(base + novel_spans(text, base, novelty, min_bits)))
        counts = [pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_written(s) for s in spans], pa.string())],
            ["id", "n_assign", "n_access", "n_hex", "n_novelty", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 identifiers: str = IDENTIFIERS, min_bits: float = MIN_BITS) -> DataFrame:
    """Per row: the id, counts by kind, the digest of the base spans and all spans, written
    ``kind:start:end`` by start, then kind, comma-joined. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: _scan(b, identifiers, min_bits),
                          f"id {kind}, n_assign long, n_access long, n_hex long, n_novelty long, "
                          "base_sha256 string, spans string")
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novelty")
