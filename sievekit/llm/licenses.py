"""License scans: Aho-Corasick phrase and tag search, and evaluation of licence expressions.

A text is lower-cased (A-Z only) and cut into words of ASCII letters and digits
and any characters beyond ASCII; joined by single blanks, these words are
searched by one Aho-Corasick automaton for notice phrases and licence-identifier
tags. Behind each tag that the automaton meets, the raw text is read as an
expression: a shunting-yard parser turns and/or/with into postfix order, and
the postfix form is evaluated to the identifiers named, and to whether a choice
exists that needs permissive licences only. A tag is followed by a colon, a slash
between identifiers means `or`, and a full stop or hyphen behind an identifier
isn't part of it. Identifiers outside the lists below are no labels and are
reported apart.

Edge cases: a null text counts as empty (no words, null first and last word,
empty labels, score 0); an expression with unbalanced or misplaced parts gives
the identifiers read up to there and no verdict; repeated rows keep their own
rows; a label that several phrases support has the largest of their weights;
texts of any length are scanned whole; an empty table gives an empty result;
scan() replaces input columns that have a name of its outputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Fixed values. Further notice phrases: words -> (label, weight as evidence of a licence notice).
NOTICE_PHRASES = {
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "the above copyright notice and this permission notice shall be included": ("mit", 0.8),
    "apache license": ("apache-2.0", 0.9),
    "apache software license": ("apache-2.0", 0.9),
    "licensed under the apache license version 2 0": ("apache-2.0", 0.95),
    "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "2 clause bsd": ("bsd-2-clause", 0.9),
    "bsd 2 clause": ("bsd-2-clause", 0.9),
    "simplified bsd license": ("bsd-2-clause", 0.9),
    "3 clause bsd": ("bsd-3-clause", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.9),
    "new bsd license": ("bsd-3-clause", 0.9),
    "neither the name of the copyright holder": ("bsd-3-clause", 0.7),
    "mozilla public license": ("mpl-2.0", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu library general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
    "gpl v2": ("gpl", 0.8),
    "gpl v3": ("gpl", 0.8),
    "gplv2": ("gpl", 0.8),
    "gplv3": ("gpl", 0.8),
    "lgplv2": ("lgpl", 0.8),
    "lgplv3": ("lgpl", 0.8),
    "agplv3": ("agpl", 0.8),
    "eclipse public license": ("epl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "common development and distribution license": ("cddl", 0.9),
    "common public license": ("cpl", 0.8),
    "artistic license": ("artistic", 0.8),
    "boost software license": ("bsl-1.0", 0.9),
    "business source license": ("busl-1.1", 0.9),
    "server side public license": ("sspl-1.0", 0.9),
    "elastic license": ("elastic-2.0", 0.8),
    "microsoft public license": ("ms-pl", 0.9),
    "python software foundation license": ("psf-2.0", 0.9),
    "academic free license": ("afl-3.0", 0.9),
    "open software license": ("osl-3.0", 0.9),
    "open font license": ("ofl-1.1", 0.9),
    "open database license": ("odbl-1.0", 0.9),
    "open government licence": ("ogl", 0.8),
    "zlib license": ("zlib", 0.8),
    "isc license": ("isc", 0.8),
    "the unlicense": ("unlicense", 0.7),
    "wtfpl": ("wtfpl", 0.8),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons zero": ("cc0-1.0", 0.8),
    "cc0": ("cc0-1.0", 0.7),
    "public domain": ("public-domain", 0.5),
    "proprietary and confidential": ("proprietary", 0.7),
}
BASE_WEIGHTS = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.6}
TAG = "spdx license identifier"
TAG_WEIGHT = 0.99

# Public licence identifiers, in small letters. Families are name -> (versions, endings), where each version
# occurs with each ending; the bare name of a version is the ending "".
PERMISSIVE_FAMILIES = {
    "afl": ("1.1 1.2 2.0 2.1 3.0", [""]),
    "apache": ("1.0 1.1 2.0", [""]),
    "cc-by": ("1.0 2.0 2.5 3.0 4.0", ["", "-at", "-au", "-de", "-igo", "-nl", "-us"]),
    "ecl": ("1.0 2.0", [""]),
    "efl": ("1.0 2.0", [""]),
    "mulanpsl": ("1.0 2.0", [""]),
    "oldap": ("1.1 1.2 1.3 1.4 2.0 2.0.1 2.1 2.2 2.2.1 2.2.2 2.3 2.4 2.5 2.6 2.7 2.8", [""]),
    "php": ("3.0 3.01", [""]),
    "python": ("2.0 2.0.1", [""]),
    "sgi-b": ("1.0 1.1 2.0", [""]),
    "zpl": ("1.1 2.0 2.1", [""]),
}
RESTRICTED_FAMILIES = {
    "agpl": ("1.0 3.0", ["", "-only", "-or-later"]),
    "apsl": ("1.0 1.1 1.2 2.0", [""]),
    "artistic": ("1.0", ["", "-cl8", "-perl"]),
    "cc-by-nc": ("1.0 2.0 2.5 3.0 4.0", ["", "-de"]),
    "cc-by-nc-nd": ("1.0 2.0 2.5 3.0 4.0", ["", "-de", "-igo"]),
    "cc-by-nc-sa": ("1.0 2.0 2.5 3.0 4.0", ["", "-de", "-fr", "-igo", "-uk"]),
    "cc-by-nd": ("1.0 2.0 2.5 3.0 4.0", ["", "-de"]),
    "cc-by-sa": ("1.0 2.0 2.1 2.5 3.0 4.0", ["", "-at", "-de", "-igo", "-jp", "-uk"]),
    "cddl": ("1.0 1.1", [""]),
    "cecill": ("1.0 1.1 2.0 2.1", [""]),
    "epl": ("1.0 2.0", [""]),
    "eupl": ("1.0 1.1 1.2", [""]),
    "gfdl": ("1.1 1.2 1.3", ["", "-only", "-or-later", "-invariants-only", "-invariants-or-later", "-no-invariants-only", "-no-invariants-or-later"]),
    "gpl": ("1.0 2.0 3.0", ["", "-only", "-or-later"]),
    "lgpl": ("2.0 2.1 3.0", ["", "-only", "-or-later"]),
    "lppl": ("1.0 1.1 1.2 1.3a 1.3c", [""]),
    "mpl": ("1.0 1.1 2.0", ["", "-no-copyleft-exception"]),
    "npl": ("1.0 1.1", [""]),
    "ofl": ("1.0 1.1", ["", "-rfn", "-no-rfn"]),
    "osl": ("1.0 1.1 2.0 2.1 3.0", [""]),
    "rpl": ("1.1 1.5", [""]),
    "sissl": ("1.2", [""]),
    "ypl": ("1.0 1.1", [""]),
}
PERMISSIVE_SINGLE = """0bsd aal adobe-2006 adsl aml amdplpa antlr-pd apafml artistic-2.0 bahyph barr beerware blueoak-1.0.0 borceux bsd-1-clause bsd-2-clause
    bsd-2-clause-freebsd bsd-2-clause-netbsd bsd-2-clause-patent bsd-2-clause-views bsd-3-clause bsd-3-clause-attribution bsd-3-clause-clear bsd-3-clause-lbnl
    bsd-3-clause-modification bsd-3-clause-open-mpi bsd-4-clause bsd-4-clause-shortened bsd-4-clause-uc bsd-source-code bsl-1.0 bzip2-1.0.5 bzip2-1.0.6 cc-pddc
    cc0-1.0 cnri-jython cnri-python crossword crystalstacker cube curl diffmark doc dotseqn dsdp dvipdfm entessa eudatagrid fair fsful fsfullr ftl
    giftware glide hpnd hpnd-sell-variant icu ijg imagemagick imlib2 info-zip intel isc jasper-2.0 json latex2e leptonica libpng libpng-2.0 libtiff linux-openib
    makeindex miros mit mit-0 mit-advertising mit-cmu mit-enna mit-feh mit-modern-variant mit-open-group mitnfa ms-pl mtll mup naumen ncsa net-snmp netcdf newsletr nist-pd
    nlod-1.0 nlpl nrl ntp odc-by-1.0 ogl-uk-1.0 ogl-uk-2.0 ogl-uk-3.0 oml openssl pddl-1.0 plexus postgresql psf-2.0 psfrag psutils qhull rdisc rsa-md ruby saxpath
    sendmail smlnj snia spencer-86 spencer-94 spencer-99 swl tcl tcp-wrappers tu-berlin-1.0 unicode-3.0 unicode-dfs-2015 unicode-dfs-2016 unlicense upl-1.0 vim
    vsl-1.0 w3c w3c-19980720 w3c-20150513 wsuipa wtfpl x11 xerox xfree86-1.1 xinetd xnet xpp zed zend-2.0 zlib zlib-acknowledgement"""
RESTRICTED_SINGLE = """bitstream-vera busl-1.1 catosl-1.1 cc-by-nc-sa-2.0-fr cecill-b cecill-c copyleft-next-0.3.0 copyleft-next-0.3.1 cpal-1.0 cpl-1.0 cpol-1.02 cua-opl-1.0
    d-fsl-1.0 elastic-2.0 erlpl-1.1 etalab-2.0 frameworx-1.0 gl2ps hippocratic-2.1 ibm-pibs intel-acpi interbase-1.0 ipa ipl-1.0 jpnic lal-1.2 lal-1.3 lgpllr liliq-p-1.1 liliq-r-1.1
    liliq-rplus-1.1 motosoto ms-rl multics nasa-1.3 nbpl-1.0 ngpl nokia nosl noweb nposl-3.0 ocsl-1.0 oclc-2.0 odbl-1.0 ogtsl oset-pl-2.1 parity-6.0.0 parity-7.0.0
    polyform-noncommercial-1.0.0 polyform-small-business-1.0.0 qpl-1.0 rhecos-1.1 rpsl-1.0 rscpl scea simpl-2.0 sissl sleepycat spl-1.0 sspl-1.0 sugarcrm-1.1.3 tapr-ohl-1.0
    tmate torque-1.1 vostrom watcom-1.0 wxwindows xskat zimbra-1.3 zimbra-1.4"""


def _listed(families: dict[str, tuple[str, list[str]]], single: str) -> frozenset[str]:
    return frozenset(single.split()) | {f"{name}-{version}{ending}" for name, (versions, endings) in families.items() for version in versions.split() for ending in endings}


PERMISSIVE = _listed(PERMISSIVE_FAMILIES, PERMISSIVE_SINGLE)
RESTRICTED = _listed(RESTRICTED_FAMILIES, RESTRICTED_SINGLE)

_WORD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: What stands behind a tag: a colon, and the expression on the same line.
_BEHIND_TAG = re.compile(rb"[ \t]*:[ \t]*([^\n\r]*)")
#: A slash between two identifiers means `or`.
_EXPRESSION = re.compile(r"\(|\)|(?<=[A-Za-z0-9.+)])/(?=[A-Za-z0-9(])|[A-Za-z0-9][A-Za-z0-9.+_-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> tuple[list[str], bool]:
    """The expression's identifiers and operators in postfix order (shunting-yard), and whether it was well formed.

    Reading stops at the first token that can't continue the expression, so
    prose after a tag's expression doesn't count as part of it.
    """
    out: list[str] = []
    waiting: list[str] = []
    wants_operand, good = True, True
    for token in _EXPRESSION.findall(expression):
        # a full stop or hyphen at the end belongs to the sentence
        low = "or" if token == "/" else token.lower().rstrip(".-_")
        if token == "(":
            if not wants_operand:
                break
            waiting.append(token)
        elif token == ")":
            if wants_operand or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif low in _PRECEDENCE:
            if wants_operand:
                good = False
                break
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[low]:
                out.append(waiting.pop())
            waiting.append(low)
            wants_operand = True
        else:
            if not wants_operand:
                break
            out.append(low)
            wants_operand = False
    if wants_operand or "(" in waiting:
        good = False
    out += [t for t in reversed(waiting) if t != "("]
    return out, good and bool(out)


def permissive(identifier: str) -> bool | None:
    """Whether a licence is permissive; null for identifiers that aren't in the lists. A plus (or later) changes nothing."""
    name = identifier.rstrip("+")
    return True if name in PERMISSIVE else False if name in RESTRICTED else None


def evaluate(expression: str) -> tuple[set[str], bool | None]:
    """Identifiers in the expression, and whether permissive licences alone satisfy it (null if ill formed or if that hangs on an unknown one).

    `or` offers a choice, `and` binds both sides, `with` adds an exception to
    the licence on its left and doesn't change the verdict.
    """
    order, good = postfix(expression)
    named = {t for t in order if t not in _PRECEDENCE}
    if not good:
        return named, None
    stack: list[tuple[bool | None, str]] = []
    for token in order:
        if token in _PRECEDENCE:
            (right, exception), (left, name) = stack.pop(), stack.pop()
            if token == "with":
                named.discard(exception)
            else:
                decides = token == "or"  # the value that settles the matter from either side
                left = decides if decides in (left, right) else None if None in (left, right) else not decides
            stack.append((left, name))
        else:
            stack.append((permissive(token), token))
    return named, stack[-1][0]


def automaton() -> ahocorasick.Automaton:
    """One automaton over all phrases, each between blanks so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _expressions(text: str | None, line: str, tags: list[int]) -> Iterator[str]:
    """What the text has behind the tags that the automaton met at these ends in the line of words."""
    if not tags:
        return
    raw = text.encode("utf-8", "surrogatepass")
    words = re.finditer(rb"[^ ]+", raw.translate(_WORD))
    counted = passed = at = 0
    for end in tags:
        counted += line.count(" ", at, end)  # as many words end before the blank at `end`
        at = end
        while passed < counted:
            word = next(words)
            passed += 1
        if behind := _BEHIND_TAG.match(raw, word.end()):
            yield behind[1].decode("utf-8", "surrogatepass")


def scan_text(text: str | None, phrases: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive, unknown) of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # one character a byte: phrases are ASCII
    n_base, first, last, base, weight = 0, None, None, set(), {}
    tags: list[int] = []
    at, index = 0, 0  # blanks counted up to `at`
    for end, phrase in phrases.iter(line):
        if phrase in BASE_PHRASES:
            start = end - len(phrase) - 1  # the blank before the phrase
            index += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            n_base += 1
            first = index if first is None else min(first, index)
            last = index if last is None else max(last, index)
            base.add(BASE_PHRASES[phrase])
        elif phrase == TAG:
            tags.append(end)
        else:
            label, w = NOTICE_PHRASES[phrase]
            weight[label] = max(weight.get(label, 0.0), w)
    for label in base:
        weight[label] = max(weight.get(label, 0.0), BASE_WEIGHTS[label])
    expressions, verdicts, unknown = [], [], set()
    for expression in _expressions(text, line, tags):
        named, verdict = evaluate(expression)
        if named:
            expressions.append(" ".join(postfix(expression)[0]))
            verdicts.append(verdict)
            for label in named:
                if permissive(label) is None:
                    unknown.add(label)
                else:
                    weight[label] = TAG_WEIGHT
    doubt = 1.0
    for label in sorted(weight):
        doubt *= 1.0 - weight[label]
    verdict = None if not verdicts or None in verdicts else all(verdicts)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(weight)), 1.0 - doubt, expressions, verdict, sorted(unknown)


_MADE = {
    "n_words": "bigint",
    "n_base": "bigint",
    "first_word": "bigint",
    "last_word": "bigint",
    "base_labels": "string",
    "labels": "string",
    "score": "double",
    "expressions": "array<string>",
    "permissive": "boolean",
    "unknown": "array<string>",
}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by what the scan finds in it; one pass, no shuffle."""
    rest = [c for c in docs.columns if c != text and c not in _MADE]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        phrases = automaton()
        for b in batches:
            found = list(zip(*(scan_text(t.as_py(), phrases) for t in b[text]))) or [()] * len(_MADE)
            yield {c: b[c] for c in rest} | dict(zip(_MADE, map(list, found)))

    head = "".join(f"`{c}` {t}, " for c, t in docs.select(*rest).dtypes)
    return map_batches(docs.select(*rest, text), run, head + ", ".join(f"{c} {t}" for c, t in _MADE.items()))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.array_join("expressions", "; ").alias("expressions"), "permissive", F.array_join("unknown", ",").alias("unknown"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
