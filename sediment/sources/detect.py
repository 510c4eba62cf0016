"""Which format a log file has, from its name and its first 64 KiB."""

from __future__ import annotations

import csv
import io
import json
import re
from dataclasses import dataclass, field

HEAD = 65_536
# The two syslog line formats; [0-9], as Python and Java don't agree on \d.
BSD = r"^([A-Z][a-z]{2})\s+([0-9]{1,2}) ([0-9]{2}:[0-9]{2}:[0-9]{2}) (\S+) ([^\s:]+?)(?:\[([0-9]+)\])?: ?(.*)$"
RFC5424 = r"^<([0-9]{1,3})>([0-9]{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|\[.*?\]) ?(.*)$"
SYSLOG_FIELDS = ["stamp", "host", "ident", "pid", "message"]


@dataclass
class Substrate:
    """A file's format and what a reader must disclose about it."""

    kind: str  # jsonl, json, delimited, text, syslog
    path: str
    delimiter: str | None = None
    dialect: str | None = None
    fields: list[str] = field(default_factory=list)
    available: int | None = None
    note: str = ""
    read: int = 0  # records, where the reader counts them
    joined: int = 0  # lines put together to fewer records
    skipped: int = 0  # lines that are in no record
    syslog: dict | None = None  # what a syslog reader assumed


def syslog_votes(head: str, most: int = 40) -> dict[str, int]:
    """bsd, rfc5424, other and continuation among the first non-blank lines; a line after a record is a continuation."""
    votes = {"bsd": 0, "rfc5424": 0, "other": 0, "continuation": 0}
    open_record = False
    for line in [x.rstrip() for x in head.splitlines() if x.strip()][:most]:
        kind = "rfc5424" if re.match(RFC5424, line) else "bsd" if re.match(BSD, line) else "continuation" if open_record else "other"
        open_record = open_record or kind in ("bsd", "rfc5424")
        votes[kind] += 1
    return votes


def sniff_syslog(head: str) -> str | None:
    """The dialect if one alone has all of fewer than three counted lines, or four fifths of more."""
    v = syslog_votes(head)
    total = v["bsd"] + v["rfc5424"] + v["other"]
    for mine, rival in (("bsd", "rfc5424"), ("rfc5424", "bsd")):
        if v[mine] and not v[rival] and (v[mine] == total if total < 3 else v[mine] >= 0.8 * total):
            return mine
    return None


def _first_object(head: str) -> list[str]:
    for line in head.splitlines():
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if isinstance(x, dict):
            return list(x)
    return []


def _is_jsonl(head: str, whole: bool) -> bool:
    lines = [x for x in head.splitlines() if x.strip()]
    if not whole and len(lines) > 1:
        lines = lines[:-1]  # the last one is cut
    if len(lines) < 2:
        return False
    try:
        for x in lines[:20]:
            json.loads(x)
    except ValueError:
        return False
    return True


def _delimiter(head: str, default: str | None) -> str | None:
    try:
        return csv.Sniffer().sniff(head[:8192], delimiters=",\t|;").delimiter
    except csv.Error:
        return default


def array_length(head: str) -> int | None:
    """Objects of a JSON array that closes within head."""
    try:
        x, _ = json.JSONDecoder().raw_decode(head.lstrip())
    except ValueError:
        return None
    return sum(isinstance(r, dict) for r in x) if isinstance(x, list) else None


def detect(path: str, data: bytes, whole: bool = True) -> Substrate:
    """The format of a file; data: its first HEAD bytes, whole: they are all of it."""
    if not data.strip():
        raise ValueError(f"{path} is empty")
    head = data.decode("utf-8", errors="replace")
    suffix = re.search(r"\.[^./]*$", path.lower())
    suffix = suffix[0] if suffix else ""
    if suffix in (".jsonl", ".ndjson") or suffix == ".json" and _is_jsonl(head, whole):
        return Substrate("jsonl", path, fields=_first_object(head))
    if suffix == ".json":
        return Substrate("json", path, available=array_length(head))
    if suffix in (".csv", ".tsv", ".psv"):
        sep = _delimiter(head, {".tsv": "\t", ".psv": "|"}.get(suffix, ","))
        return Substrate("delimited", path, delimiter=sep, fields=[x.strip() for x in next(csv.reader(io.StringIO(head), delimiter=sep), [])])
    v = syslog_votes(head)
    if v["bsd"] and v["rfc5424"]:
        return Substrate("text", path, fields=["message"], note=f"mixed syslog dialects ({v['bsd']} BSD, {v['rfc5424']} RFC 5424); read as text")
    if dialect := sniff_syslog(head):
        return Substrate("syslog", path, dialect=dialect, fields=SYSLOG_FIELDS, note=f"syslog {dialect}" + "; the year is not in the file" * (dialect == "bsd"))
    first = head.lstrip()[:1]
    if first == "[" and array_length(head) is not None:
        return Substrate("json", path, available=array_length(head))
    if first in ("{", "["):
        return Substrate("jsonl", path, fields=_first_object(head))
    lines = [x for x in head.splitlines() if x.strip()][:20]
    if len(lines) >= 2 and all("," in x or "\t" in x for x in lines) and (sep := _delimiter(head, None)):
        return Substrate("delimited", path, delimiter=sep, fields=[x.strip() for x in next(csv.reader(io.StringIO(head), delimiter=sep), [])])
    return Substrate("text", path, fields=["message"], note="no structure detected; each line is one record with a single 'message' field")
