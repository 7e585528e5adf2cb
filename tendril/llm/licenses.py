"""License scans: phrases and tags found by one Aho-Corasick automaton, tag expressions judged by a shunting-yard parser.

Words are the runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII; phrases match whole words that
stand consecutively. ``BASE`` phrases give the base labels; ``NOTICES`` and identifier tags add the method's labels. What
follows ``SPDX-License-Identifier:`` on its line is an expression over licence ids with ``and``, ``or``, ``with`` and
parentheses; it gives the labels of its ids, and is allowed if an allow-list satisfies it (all sides of an ``and``, one
of an ``or``; ``with`` binds an exception to its licence). A malformed expression gives no labels and isn't allowed. An id
that is no name of the list with versions and known words behind it gives no label and is not allowed, nor is a licence with
an unknown exception; the labels of the other ids stay.

score is 1 - product of (1 - weight) over the distinct pieces of evidence, 0 without any.

Defined results: a null text is an empty one, with no words or labels; places may overlap and each counts; a phrase
repeated counts at each place but once as evidence. Texts are read whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import LOWER_WORDS_TABLE, blocks

# Phrases and the labels that they stand for.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc",
}
TAG = "spdx license identifier"
# Names of the public list's licences, lower-cased, which are their labels; the longest name counts. Ids are
# these names with versions and some of the words below behind them.
IDS = (
    "mit", "apache", "gpl", "lgpl", "agpl", "mpl", "epl", "bsd", "isc", "unlicense", "cc0", "cc-by", "cc-by-sa", "cc-by-nc",
    "0bsd", "aal", "adsl", "afl", "apafml", "apl", "apsl", "artistic", "bahyph", "barr", "beerware", "blueoak", "borceux", "bsl", "busl",
    "caldera", "catosl", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-pddc", "cddl", "cecill", "cecill-b", "cecill-c", "clartistic", "cnri-jython",
    "cnri-python", "condor", "cpal", "cpl", "cpol", "crossword", "cua-opl", "cube", "curl", "d-fsl", "doc", "dotseqn", "dsdp", "ecl", "efl", "egenix",
    "elastic", "entessa", "erlpl", "eudatagrid", "eupl", "eurosym", "fair", "frameworx", "freeimage", "fsfap", "fsful", "fsfullr", "ftl", "gfdl",
    "giftware", "gl2ps", "glide", "glulxe", "gnuplot", "hpnd", "icu", "ijg", "imagemagick", "imatix", "imlib2", "intel", "intel-acpi", "interbase", "ipa",
    "ipl", "jasper", "jpnic", "json", "lal", "latex2e", "libpng", "libtiff", "liliq-p", "liliq-r", "liliq-rplus", "lpl", "lppl", "miros", "motosoto",
    "mpich2", "ms-lpl", "ms-pl", "ms-rl", "mulanpsl", "multics", "mup", "nasa", "naumen", "ncsa", "net-snmp", "netcdf", "newsletr", "ngpl", "nlod", "nlpl",
    "nokia", "nosl", "noweb", "npl", "nposl", "nrl", "ntp", "oclc", "odbl", "odc-by", "ofl", "ogl", "ogtsl", "oldap", "oml", "openssl", "opl", "oset-pl", "osl",
    "parity", "pddl", "php", "plexus", "postgresql", "psf", "psutils", "python", "qhull", "qpl", "rdisc", "rhecos", "rpl", "rpsl", "rsa-md", "rscpl", "ruby",
    "sax-pd", "scea", "sgi-b", "simpl", "sissl", "sleepycat", "smlnj", "snia", "spencer", "sspl", "sugarcrm", "tcl", "tcp-wrappers", "tmate", "torque", "unicode",
    "upl", "vim", "vostrom", "vsl", "w3c", "watcom", "wsuipa", "wtfpl", "x11", "xerox", "xinetd", "xnet", "xpp", "xskat", "ypl", "zed", "zend", "zimbra", "zlib", "zpl",
)
# Words that stand in ids behind a name or version.
WORDS = "only|or|later|clause|clear|patent|attribution|no|nuclear|license|licence|warranty|military|open|source|code|views|lbnl|uc|advertising|cmu|enna|feh|modern|variant|festival|perl|cl8|invariants|shortened|rfn|tou|dfs|acknowledgement|sell|netbsd|simplified|igo|at|au|de|nl|us|uk|fr|jp|eg|dcma|rlx|mpi|l|p|p2|uk|94|86|99"
# Names that stand behind ``with``: those that end in ``exception``, with a version or without, and these.
EXCEPTIONS = ("linux-syscall-note", "gpl-cc", "shl")
ALLOWED = ("mit", "apache", "bsd", "isc", "unlicense", "cc0", "cc-by")
WEIGHT_BASE, WEIGHT_NOTICE, WEIGHT_TAG, WEIGHT_MALFORMED = 0.6, 0.8, 0.95, 0.3

_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_PART = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


_BEHIND = re.compile(rf"(?:-(?:v?[0-9]+(?:\.[0-9]+)*[a-z]?|{WORDS}))*\+?")
_EXCEPTION = re.compile(rf"(?:[a-z0-9]+(?:\.[0-9]+)?-)*(?:exception|{'|'.join(EXCEPTIONS)})(?:-[0-9]+(?:\.[0-9]+)*)?")


@functools.cache
def label(licence: str) -> str | None:
    """The label of a licence id, None if it is no name of the list with versions and known words behind it. References to
    licences of one's own are ``licenseref``."""
    low = licence.lower()
    if re.fullmatch(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", low):
        return "licenseref"
    fits = [x for x in IDS if low.startswith(x) and _BEHIND.fullmatch(low, len(x))]
    return max(fits, key=len, default=None)


def is_exception(name: str) -> bool:
    return _EXCEPTION.fullmatch(name.lower()) is not None


def postfix(expression: str) -> list[str] | None:
    """The expression with operators behind their operands, by a shunting yard; None if it is malformed."""
    end = re.match(r"[\sA-Za-z0-9.+:_()-]*", expression)
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the last part was an operand or closed one
    for part in _PART.findall(end[0] if end else ""):
        op = part.lower()
        if part in ("--", "-"):  # of a comment's end
            break
        if op in _PRECEDENCE:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[op]:
                out.append(waiting.pop())
            waiting.append(op)
            operand = False
        elif part == "(":
            if operand:
                return None
            waiting.append(part)
        elif part == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting or not operand:
                return None
            waiting.pop()
        elif operand:
            return None
        else:
            out.append(part)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(parts: list[str], allowed: frozenset[str]) -> tuple[bool, set[str]]:
    """(whether the allowed labels satisfy the expression, labels of its known licences). What is unknown, licence or
    exception, is not allowed, and takes no label away."""
    stack: list[bool] = []
    labels: set[str] = set()
    for k, part in enumerate(parts):
        if part in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if part == "or" else a and b)
        elif k + 1 < len(parts) and parts[k + 1] == "with":  # an exception, not a licence
            stack.append(is_exception(part))
        else:
            own = label(part)
            labels |= {own} - {None}
            stack.append(own in allowed)
    return stack[-1], labels


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    told: dict[str, list[tuple[str, str]]] = {TAG: [("tag", "")]}
    for kind, phrases in (("base", BASE), ("notice", NOTICES)):
        for phrase, name in phrases.items():
            told.setdefault(phrase, []).append((kind, name))
    for phrase, what in told.items():
        found.add_word(f" {phrase} ", (phrase, what))
    found.make_automaton()
    return found


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, allowed boolean, score double"
_TYPES = [pa.int64()] * 4 + [pa.list_(pa.string())] * 3 + [pa.bool_(), pa.float64()]


def scan_text(raw: bytes, machine: ahocorasick.Automaton, allowed: frozenset[str]) -> tuple:
    words = raw.translate(LOWER_WORDS_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    text = line.decode()
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    evidence: dict[str, float] = {}
    tagged = False
    at = n_before = 0  # words before ``at``
    for end, (phrase, what) in machine.iter(text):
        n_before += text.count(" ", at, end)
        at = end
        for kind, name in what:
            if kind == "tag":
                tagged = True
                continue
            labels.add(name)
            if kind == "base":
                places.append(n_before - phrase.count(" ") - 1)
                base.add(name)
            evidence[f"{kind} {phrase}"] = WEIGHT_BASE if kind == "base" else WEIGHT_NOTICE
    expressions: list[str] = []
    fine: list[bool] = []
    for m in _TAG_LINE.findall(raw) if tagged else ():
        parts = postfix(m.decode(errors="replace"))
        ok, own = evaluate(parts, allowed) if parts else (False, set())
        fine.append(ok)
        labels |= own
        if own:
            expressions.append(" ".join(parts))
        evidence[f"tag {parts}"] = WEIGHT_TAG if own else WEIGHT_MALFORMED
    miss = 1.0
    for _, w in sorted(evidence.items()):
        miss *= 1 - w
    verdict = all(fine) if fine else labels <= allowed if labels else None
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), expressions, verdict, 1 - miss


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base_labels, labels, expressions, allowed, score).

    row: the document as a struct; expressions: those of the tags, in postfix order; allowed: whether the tags, or without
    tags the labels, are within the allow-list; null if the text names no licence.
    """
    fine = frozenset(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            out: list[tuple] = []
            for _, _, data, off in blocks(b.column(0).field(text)):
                raw = data.tobytes()
                out += [scan_text(raw[s:e], machine, fine) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            columns = zip(*out, strict=True) if out else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["row", *(x.split()[0] for x in SCHEMA.split(", "))])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {SCHEMA}")


def report(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document."""
    found = scan(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score", "allowed")
