"""Turtle as a source: statements cut out of file splits, prefixes sent to all tasks, terms parsed in tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed

# Namespaces of common vocabularies, for files that use their prefixes undeclared.
KNOWN = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#", "sh": "http://www.w3.org/ns/shacl#", "skos": "http://www.w3.org/2004/02/skos/core#",
}
ROWS = "s string, p string, o string, o_kind string, datatype string, lang string, problem string, file string"
MOST_DIRECTIVES = 100_000

_MARK = re.compile(r"""(?P<long>\"{3}|'{3})|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|<[^<>"\s]*>|\#.*|(?P<end>\.(?=[\s\#<@"\[(]|$))""")
_CLOSE = {'"""': re.compile(r'(?:[^"\\]|\\.?|"(?!""))*"""(?!")|(?:[^"\\]|\\.?|"(?!""))*"""'), "'''": re.compile(r"(?:[^'\\]|\\.?|'(?!''))*'''")}
_SPARQL = re.compile(r"\s*(?:PREFIX\s+[^\s:<]*:|BASE)\s*<[^<>]*>", re.I)
_DIRECTIVE = re.compile(r"\s*(?:\#[^\n]*\n\s*)*@?(?:(?P<prefix>prefix)\s+(?P<name>[^\s:<]*):|base)\s*<(?P<iri>[^<>]*)>\s*\.?\s*(?:\#[^\n]*)?\Z", re.I)
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\s]*>)|(?P<text>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))"""
    r"""|(?P<blank>_:\w(?:[\w.-]*[\w-])?)|(?P<name>(?:\w(?:[\w.-]*[\w-])?)?:(?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)|(?P<word>[a-zA-Z]+)|(?P<mark>[;,.\[\]()])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text) if "\\" in text else text


def _scan(line: str, state: str, at: int = 0) -> tuple[str, list[int]]:
    """The state after a line (outside, or inside a text of three quotes), and the places after the full stops that end statements in it."""
    ends = []
    while at <= len(line):
        if state:
            m = _CLOSE[state].match(line, at)
            if not m:
                return state, ends
            at, state = m.end(), ""
        m = _MARK.search(line, at)
        if not m:
            break
        at = m.end()
        if m["long"]:
            state = m["long"]
        elif m["end"]:
            ends.append(at)
    return state, ends


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, the state at its end for every state that it may start in."""
    seen: dict[tuple[str, int], list[str]] = {}
    for file, block, line in _lines(batches):
        held = seen.setdefault((file, block), ["", '"""', "'''"])
        held[:] = [_scan(line, s)[0] for s in held]
    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.int64()), pa.array(list(seen.values()), pa.list_(pa.string()))], ["file", "block", "ends"])


def _pieces(batches: Iterator[pa.RecordBatch], starts: Mapping[tuple[str, int], str]) -> Iterator[pa.RecordBatch]:
    """Statements that lie in one split, and the pieces before the first and after the last full stop of a split."""
    here, state, parts, seq, ended = None, "", [], 0, False
    out: list[tuple] = []

    def put(kind: str) -> None:
        nonlocal seq
        text = "".join(parts)
        parts.clear()
        if text.strip() or kind != "whole statement":
            out.append((*here, seq, kind, text))
        seq += 1

    def records() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["file", "block", "seq", "kind", "text"])

    for file, block, line in _lines(batches):
        if (file, block) != here:
            if here:
                put("last" if ended else "middle")
            here, state, seq, ended = (file, block), starts[file, block], 0, block == 0
        at = 0
        if not state and ended and (m := _SPARQL.match(line)) and not "".join(parts).strip():
            parts[:] = [m[0]]
            put("whole statement")
            at = m.end()
        state, ends = _scan(line, state, at)
        for end in ends:
            parts.append(line[at:end])
            put("whole statement" if ended else "first")
            at, ended = end, True
        parts.append(line[at:] + "\n")
        if len(out) > 5000:
            yield records()
    if here:
        put("last" if ended else "middle")
    yield records()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements over several splits, from their pieces in order; a rest without a full stop is one of its own."""
    now, place, parts = None, None, []
    out: list[tuple] = []

    def rest() -> None:
        text = "".join(parts)
        parts.clear()
        while m := _SPARQL.match(text):
            out.append((now, *place, m[0]))
            text = text[m.end() :]
        if now is not None and text.strip():
            out.append((now, *place, text))

    for batch in batches:
        for file, block, seq, kind, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if file != now:
                rest()
                now, place = file, (block, seq)
            if not parts:
                place = (block, seq)
            parts.append(text)
            if kind == "first":
                rest()
    rest()
    columns = list(zip(*out)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "block", "seq", "text"])


class _Statement:
    """One statement's triples; blank nodes without a name are named by their place."""

    def __init__(self, text: str, prefixes: Mapping[str, str], base: str, place: str, scope: str):
        self.tokens: list[tuple[str, str]] = []
        self.prefixes, self.base, self.place, self.scope, self.blanks = prefixes, base, place, scope, 0
        self.found: list[tuple] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.reverse()

    def next(self, *wanted: str) -> tuple[str, str]:
        kind, text = self.tokens.pop() if self.tokens else ("end", "")
        if wanted and text not in wanted:
            raise ValueError(f"unexpected {text!r}")
        return kind, text

    def at(self, *texts: str) -> bool:
        return bool(self.tokens) and self.tokens[-1][1] in texts and self.tokens[-1][0] == "mark"

    def fresh(self) -> tuple:
        self.blanks += 1
        return (f"_:{self.place}-{self.blanks}", "blank", None, None)

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return urljoin(self.base, _unescaped(text[1:-1])) if self.base else _unescaped(text[1:-1])
        prefix, local = text.split(":", 1)
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def term(self) -> tuple:
        """(text, kind, datatype, language) of a subject or object."""
        kind, text = self.next()
        if kind in ("iri", "name"):
            return (self.iri(kind, text), "iri", None, None)
        if kind == "blank":
            return (f"_:{self.scope}-{text[2:]}", "blank", None, None)
        if text == "[":
            node = self.fresh()
            self.properties(node[0], "]")
            self.next("]")
            return node
        if text == "(":
            items = []
            while not self.at(")"):
                items.append(self.term())
            self.next(")")
            cells = [self.fresh() for _ in items] + [(KNOWN["rdf"] + "nil", "iri", None, None)]
            for cell, item, rest in zip(cells, items, cells[1:]):
                self.found += [(cell[0], KNOWN["rdf"] + "first", item), (cell[0], KNOWN["rdf"] + "rest", rest)]
            return cells[0]
        xsd = KNOWN["xsd"]
        if kind == "number":
            return (text, "literal", xsd + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None)
        if text in ("true", "false"):
            return (text, "literal", xsd + "boolean", None)
        if kind == "text":
            value = _unescaped(text[3:-3] if text[:3] in ('"""', "'''") and len(text) > 5 else text[1:-1])
            if self.tokens and self.tokens[-1][0] == "lang":
                return (value, "literal", KNOWN["rdf"] + "langString", self.next()[1][1:].lower())
            if self.tokens and self.tokens[-1][0] == "type":
                self.next()
                kind, text = self.next()
                if kind not in ("iri", "name"):
                    raise ValueError(f"no datatype: {text!r}")
                return (value, "literal", self.iri(kind, text), None)
            return (value, "literal", xsd + "string", None)
        raise ValueError(f"unexpected {text!r}")

    def properties(self, subject: str, close: str) -> None:
        while not self.at(close):
            kind, text = self.next()
            if kind not in ("iri", "name") and text != "a":
                raise ValueError(f"no predicate: {text!r}")
            predicate = KNOWN["rdf"] + "type" if text == "a" else self.iri(kind, text)
            while True:
                self.found.append((subject, predicate, self.term()))
                if not self.at(","):
                    break
                self.next()
            while self.at(";"):
                self.next()
                if self.at(close):
                    return
            if not self.at(close) and not self.tokens:
                raise ValueError("the statement has no end")

    def triples(self) -> list[tuple]:
        opens = self.at("[")
        subject = self.term()
        if subject[1] == "literal":
            raise ValueError(f"a literal as subject: {subject[0]!r}")
        if not (opens and self.at(".")):
            if self.at("."):
                raise ValueError("a subject alone")
            self.properties(subject[0], ".")
        self.next(".")
        if self.tokens:
            raise ValueError(f"unexpected {self.tokens[-1][1]!r}")
        return self.found


def _parsed(batches: Iterator[pa.RecordBatch], directives: Mapping[str, list[tuple]], known: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file, block, seq, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            bare = re.sub(r"^\s*(?:#[^\n]*\n\s*)*", "", text + "\n")
            if not bare.strip() or bare.startswith("#") or _DIRECTIVE.match(text):
                continue
            prefixes, base = dict(known), ""
            for where, name, iri in directives.get(file, ()):
                if where > (block, seq):
                    break
                if name is None:
                    base = urljoin(base, iri) if base else iri
                else:
                    prefixes[name] = urljoin(base, iri) if base else iri
            scope = hashlib.sha256(file.encode()).hexdigest()[:12]
            try:
                found = _Statement(text, prefixes, base, f"{scope}-{block}-{seq}", scope).triples()
            except (ValueError, IndexError, OverflowError) as wrong:
                out.append((None, None, text, None, None, None, str(wrong), file))
                continue
            out += [(s, p, *o, None, file) for s, p, o in found]
        columns = list(zip(*out)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f.split()[0] for f in ROWS.split(", ")])


def read_turtle(spark: SparkSession, path: str, known: Mapping[str, str] = KNOWN) -> tuple[DataFrame, DataFrame]:
    """The triples (s, p, o, o_kind, datatype, lang, file) of Turtle files, and their malformed statements (text, problem, file).

    Files are read by splits. A first pass tells in which state, outside or inside a text of three
    quotes, each split ends for every state it may start in, so that the driver, with a row a
    split, knows how each starts. The second pass cuts statements; those over several splits are
    put together from their pieces. Prefixes and bases hold from their place in their file on, and
    ``known`` ones without a declaration; they alone go to all tasks. IRIs are absolute
    where a base is known. Named blank nodes are kept apart by file, others are named by their
    place. A triple stated twice is there twice. A statement that can't be read, or never
    ends, is malformed and no other is harmed.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts: dict[tuple[str, int], str] = {}
    now, state = None, ""
    for r in sorted(lines.mapInArrow(_states, "file string, block long, ends array<string>").collect(), key=lambda r: (r["file"], r["block"])):
        state = "" if r["file"] != now else state
        now, starts[r["file"], r["block"]] = r["file"], state
        state = r["ends"][("", '"""', "'''").index(state)]
    pieces = checkpointed(lines.mapInArrow(lambda b: _pieces(b, starts), "file string, block long, seq long, kind string, text string"))
    cut = pieces.where("kind <> 'whole statement'").repartition("file").sortWithinPartitions("file", "block", "seq").mapInArrow(_joined, "file string, block long, seq long, text string")
    statements = checkpointed(pieces.where("kind = 'whole statement'").drop("kind").unionByName(cut))
    said = statements.where(F.col("text").rlike(r"(?is)^\s*(#[^\n]*\n\s*)*@?(prefix|base)\b")).limit(MOST_DIRECTIVES + 1).collect()
    if len(said) > MOST_DIRECTIVES:
        raise ValueError(f"more than {MOST_DIRECTIVES} prefixes")
    directives: dict[str, list[tuple]] = {}
    for r in sorted(said, key=lambda r: (r["file"], r["block"], r["seq"])):
        if m := _DIRECTIVE.match(r["text"]):
            directives.setdefault(r["file"], []).append(((r["block"], r["seq"]), m["name"] if m["prefix"] else None, m["iri"]))
    known = dict(known)
    rows = checkpointed(statements.mapInArrow(lambda b: _parsed(b, directives, known), ROWS))
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL").select(F.col("o").alias("text"), "problem", "file")


def compacted(triples: DataFrame, base: str = "http://example.com/schema/", known: Mapping[str, str] = KNOWN) -> DataFrame:
    """(s, p, o) as the stores here name things: without the base, and with prefixes for known vocabularies."""

    def short(c: str) -> Column:
        out = F.when(F.startswith(c, F.lit(base)), F.substr(c, F.lit(len(base) + 1)))
        for prefix, iri in known.items():
            out = out.when(F.startswith(c, F.lit(iri)), F.concat(F.lit(f"{prefix}:"), F.substr(c, F.lit(len(iri) + 1))))
        return out.otherwise(F.col(c))

    return triples.select(short("s").alias("s"), short("p").alias("p"), F.when(F.col("o_kind") == "iri", short("o")).otherwise(F.col("o")).alias("o"))
