"""Personal data: span candidates, gradient-boosted trees, calibrated thresholds, redaction.

High-recall generators propose overlapping spans: the base kinds (email, ip,
card, phone), written-out mail addresses, number groups of many forms (telephone,
card and identity numbers), names beside titles or naming words, postal addresses
and codes of letters and digits (account and passport numbers). Base spans that
pass their format's test are always kept. All other candidates that no base span
covers are described by their format and their context, and boosted trees score
them.

No row is labelled, so the trees learn from made examples in real surroundings:
EXAMPLES spans, personal data of each kind and look-alikes (quantities, dates,
versions, part numbers), are written into places of the texts, found by the same
generators and described as they stand there. Which ones are personal is known,
and is no function of one feature: both sorts occur with and without words that
name them, in shared formats. Base spans near these places are examples too, with
their format's test hidden from half of them, so that the trees learn from the
rest. The texts are about FIT_TEXTS different ones, drawn by hash; a smaller table
gives more places of each text, so that trees and thresholds exist at every size.
A kind's threshold is the least score from which PRECISION of its examples that
the trees haven't seen are right.

Edge cases: a null text counts as empty (no spans); a table without any text has
no trees; repeated rows get equal results; an empty table gives an empty result;
redact() keeps all other columns, find() keeps doc_id only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, in_task, map_batches, read, stored, to_tasks
from .labelled import sigmoid

#: Base kinds in the order that breaks ties, then those that only the trees decide.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("written_email", "number", "name", "address", "code")
KINDS = BASE + EXTRA
WRITTEN, NUMBER, NAME, ADDRESS, CODE = range(len(BASE), len(KINDS))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WRITTEN = re.compile(r"(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}", re.IGNORECASE)
_DOT = re.compile(r"[ (\[][Dd][Oo][Tt][ )\]]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,}(?:[ ().-]{1,3}[0-9]{2,}){0,8}(?![0-9A-Za-z])")


#: Titles, streets, and words that stand beside names without being one.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sra")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace", "Way")
GENERIC = ("Sir", "Madam", "Team", "All", "President", "Speaker", "Chairman", "Minister", "Customer", "Department", "Office", "University", "Company", "Committee", "Friends", "Colleagues")
ENDINGS = ("com", "org", "net", "edu", "info", "io", "de", "fr", "es", "uk")
#: Words of the context that name what stands beside them.
CONTEXT = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "telephone"),
    "card": ("card", "visa", "credit", "mastercard", "debit", "karte", "carte", "tarjeta"),
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "id": ("ssn", "passport", "social", "account", "iban", "konto", "identity", "licence"),
    "name": ("name", "signed", "dear", "regards", "patient", "employee"),
    "home": ("lives", "address", "home", "resident", "adresse", "wohnt", "domicile", "domicilio"),
    "amount": ("total", "units", "of", "about", "version", "order", "part", "model", "page", "items", "date", "since"),
}

_CAPITAL = r"[A-Z\u00c0-\u00de][\w'’-]{1,24}"
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? {_CAPITAL}(?: {_CAPITAL}){{0,2}}")
_NAMED = re.compile(rf"(?<!\w)(?i:name|signed|dear|regards|patient|employee)(?: is)?[:,]? ({_CAPITAL}(?: {_CAPITAL}){{1,2}})")
_NAMING = ("name", "signed", "dear", "regards", "patient", "employee")
_ADDRESSES = (
    re.compile(rf"(?<!\w)[0-9]{{1,5}}[A-Za-z]? (?:{_CAPITAL} ){{1,3}}(?:{'|'.join(STREETS)})(?!\w)"),
    re.compile(r"(?<!\w)[0-9]{1,4},? (?:rue|avenue|boulevard|place|chemin) (?:de |du |des |la |le |l')*" + _CAPITAL),
)
_GERMAN = re.compile(r"(?<!\w)[A-ZÄÖÜ][\w-]{2,30}?(?:straße|strasse|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?(?!\w)")
_SPANISH = re.compile(r"(?<!\w)(?i:calle|avenida|plaza|paseo) (?:de |del |la |las |los )*" + _CAPITAL + r",? [0-9]{1,4}(?!\w)")
_CODE = re.compile(r"(?<![0-9A-Za-z])[A-Z]{1,3}(?=[0-9]{6,9}(?![0-9A-Za-z])|[0-9]{2} ?[A-Z0-9]{4}(?: ?[A-Z0-9]{4}){1,6})(?:[0-9]{6,9}(?![0-9A-Za-z])|[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))")

REACH = 32
FEATURES = (
    *(f"is_{k}" for k in KINDS),
    *("length", "digits", "groups", "spaces", "hyphens", "dots", "parens", "plus", "luhn", "octets", "fits", "distinct_digits"),
    *("first_group", "last_group", "largest_group", "zero_first", "date", "mod_97", "capitals", "titled", "generic", "ending"),
    *(f"near_{k}" for k in CONTEXT),
    *("money", "letter_before", "letter_after", "line_start"),
)
#: Different texts, in the mean, that examples are written into; examples in all; characters of a text on either side of one.
FIT_TEXTS, EXAMPLES, AROUND = 3_000, 12_000, 200
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 16
PRECISION = 0.98
#: Share of the examples for the thresholds, and share of base examples whose format's test is hidden.
CURVE_PART, HIDDEN_PART = 0.3, 0.5

_WORDS = re.compile(r"[a-z]+")
_GROUPS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: every @ with the longest local part before it and the longest domain behind it.

    Going from @ to @ takes linear time; an expression that starts with the
    local part would try every place of a long run.
    """
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, place of the kind, end, fits) of all matches of the base kinds; only those that fit are personal data."""
    found = [(s, 0, e, 1) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(m.start(), 1, m.end(), int(all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) > 6:
            found.append((m.start(), 2, m.end(), int(14 <= len(digits) <= 19 and luhn(digits))))
    if "+" in text:
        found += [(m.start(), 3, m.end(), int(10 <= len(_digits(m[0])) <= 15)) for m in _PHONE.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """Base matches and the wider generators' spans, overlapping as they come."""
    found = base_spans(text)
    for m in _WRITTEN.finditer(text) if _DOT.search(text) else ():
        # the local part stands before what the expression finds
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        low = start
        while low > 0 and text[low - 1] in _LOCAL:
            low -= 1
        if low < start:
            found.append((low, WRITTEN, m.end(), 0))
    if any(t in text for t in TITLES):
        found += [(m.start(), NAME, m.end(), 0) for m in _TITLED.finditer(text)]
    small = text.lower()
    if any(t in small for t in _NAMING):
        found += [(m.start(1), NAME, m.end(1), 0) for m in _NAMED.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), NUMBER, m.end(), 0) for m in _NUMBER.finditer(text) if 7 <= len(_digits(m[0])) <= 19]
        for pattern in _ADDRESSES:
            found += [(m.start(), ADDRESS, m.end(), 0) for m in pattern.finditer(text)]
        if any(t in text for t in ("straße", "strasse", "weg ", "platz ", "gasse ", "allee ")):
            found += [(m.start(), ADDRESS, m.end(), 0) for m in _GERMAN.finditer(text)]
        if any(t in small for t in ("calle ", "avenida ", "plaza ", "paseo ")):
            found += [(m.start(), ADDRESS, m.end(), 0) for m in _SPANISH.finditer(text)]
        found += [(m.start(), CODE, m.end(), 0) for m in _CODE.finditer(text)]
    return sorted(set(found))


def mod_97(code: str) -> bool:
    """Whether an account number of the international form has right check digits."""
    s = code.replace(" ", "")
    return len(s) >= 15 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: tuple[int, int, int, int]) -> list[float]:
    start, place, end, fits = span
    s = text[start:end]
    digits = _digits(s)
    around = set(_WORDS.findall(text[max(0, start - REACH) : start].lower())) | set(_WORDS.findall(text[end : end + REACH // 2].lower()))
    before, after = text[start - 1 : start], text[end : end + 1]
    octets, groups, words = s.split("."), [len(g) for g in _GROUPS.findall(s)] or [0], re.findall(r"\w+", s)
    return [
        *(float(place == k) for k in range(len(KINDS))),
        *(len(s), len(digits), len(groups), s.count(" "), s.count("-"), s.count("."), s.count("("), float("+" in s)),
        *(float(len(digits) > 1 and luhn(digits)), float(len(octets) == 4 and all(o.isdigit() and len(o) < 4 and int(o) < 256 for o in octets)), float(fits), len(set(digits))),
        *(groups[0], groups[-1], max(groups), float(digits[:1] == "0"), float(groups in ([4, 2, 2], [2, 2, 4])), float(place == CODE and mod_97(s))),
        *(sum(w[0].isupper() for w in words), float(any(w in TITLES for w in words)), float(any(w in GENERIC for w in words)), float(words[-1].lower() in ENDINGS if words else 0)),
        *(float(any(w in around for w in near)) for near in CONTEXT.values()),
        *(float(before in "$€£" and before != "" or after in "%$€£" and after != ""), float(before.isalpha()), float(after.isalpha()), float(before in ("", "\n"))),
    ]


_FORMAT = [FEATURES.index(x) for x in ("fits", "luhn", "octets")]
_NEAR = [FEATURES.index(f"near_{k}") for k in CONTEXT if k != "amount"]


class Maker:
    """Made examples: (text before, span, text behind, place of the kind, whether it is personal)."""

    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)

    def one(self, of):
        return of[int(self.draw.integers(len(of)))]

    def filled(self, form: str) -> str:
        """# is a digit, A a capital letter, * a capitalised word and ~ a small one."""
        syllables = ("an", "be", "cor", "da", "el", "fi", "gar", "hol", "is", "ka", "lin", "mor", "ne", "os", "pe", "ra", "son", "ti", "ul", "vi")
        out = []
        for c in form:
            if c in "*~":
                word = "".join(self.one(syllables) for _ in range(int(self.draw.integers(2, 4))))
                c = word.capitalize() if c == "*" else word
            out.append(str(self.draw.integers(10)) if c == "#" else chr(65 + int(self.draw.integers(26))) if c == "A" else c)
        return "".join(out)

    def account(self) -> str:
        body = self.filled("#" * int(self.draw.integers(14, 21)))
        land = self.one(("DE", "FR", "ES", "GB", "NL", "AT"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return s if self.draw.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def __call__(self) -> tuple[str, str, str, int, int]:
        kind, personal = int(self.draw.integers(len(BASE), len(KINDS))), int(self.draw.random() < 0.5)
        near = lambda k: self.one(CONTEXT[k]) + self.one((" ", ": ", " is ", " no. ", " number "))
        bare = self.draw.random() < 0.3
        before, behind = "", self.one(("", "", ",", ".", " today", " please"))
        if kind == NUMBER:
            if personal:
                form, k = self.one((("0##-###-####", "phone"), ("(0##) ### ####", "phone"), ("0### ######", "phone"), ("###.###.####", "phone"), ("#### #### #### ####", "card"), ("####-####-####-####", "card"), ("###-##-####", "id"), ("#########", "id"), ("##########", "id"), ("########", "id")))
                span, before = self.filled(form), "" if bare and form in ("(0##) ### ####", "###-##-####", "0##-###-####") else near(k)
            else:
                span = self.filled(self.one(("########", "#######", "##########", "################", "20##-##-##", "##.##.20##", "### ### ###", "20##########", "978-##-######-##", "###-##-####", "####-####-####-####", "##########")))
                before = "" if bare else self.one(("total ", "order ", "part ", "about ", "version ", "model ", "date ", "since ", "$", "page "))
                behind = self.one((" units", " of", " items", "%", "", "", ","))
                if bare and span.count("-"):
                    before = "part "
        elif kind == WRITTEN:
            at, dot = self.one(((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot ")))
            span = self.filled(self.one(("~.~", "~", "~_~", "~##"))) + at + self.filled("~") + dot + (self.one(ENDINGS) if personal else self.filled("~"))
            before = "" if bare or not personal else near("email")
        elif kind == NAME:
            titled = self.draw.random() < 0.7
            span = self.filled(self.one(("* *", "*", "* * *") if titled else ("* *", "* * *")))
            if not personal:
                span = self.one(GENERIC) + ("" if titled and self.draw.random() < 0.5 else self.filled(" *"))
            if titled:
                span = self.one(TITLES) + self.one((" ", ". ")) + span
            before = self.one(("", "by ", "with ")) if titled else self.one(("name: ", "name is ", "signed, ", "Dear ", "regards, ", "patient "))
        elif kind == ADDRESS:
            span = self.filled(self.one((f"### * {self.one(STREETS)}", f"## * * {self.one(STREETS)}", "##, rue de *", "## avenue *", f"*{self.one(('straße', 'weg', 'platz'))} ##", "Calle de *, ##")))
            if personal:
                before = "" if bare else near("home")
            else:
                before = self.one(("about ", "page ", "version ", "total ", "order "))
        else:
            span = self.account() if personal and self.draw.random() < 0.5 else self.filled(self.one(("AA#######", "A########", "AAA######")))
            if personal:
                before = "" if bare and len(span) > 12 else near("id")
            else:
                before = self.one(("", "part ", "model ", "order ", "version "))
                if self.draw.random() < 0.3:
                    span = self.filled("AA## #### #### ####")
        return before, span, behind, kind, personal


class Trees:
    """Logistic gradient boosting over histograms: each tree is complete, of DEPTH levels, with one split for each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.first = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.first)
        for _ in range(TREES):
            p = sigmoid(score)
            gradient, curve = y - p, p * (1 - p)
            node, columns, bins = np.zeros(len(y), np.int64), [], []
            for level in range(DEPTH):
                n = 1 << level
                best = np.full(n, -1.0)
                column, cut = np.zeros(n, np.int64), np.full(n, BINS)
                total_g, total_h = np.bincount(node, gradient, n), np.bincount(node, curve, n)
                for c in range(x.shape[1]):
                    key = node * BINS + binned[:, c]
                    g = np.bincount(key, gradient, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    h = np.bincount(key, curve, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                    gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                    gain[:, -1] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(n), at] > np.maximum(best, 1e-9)
                    best = np.where(better, gain[np.arange(n), at], best)
                    column, cut = np.where(better, c, column), np.where(better, at, cut)
                columns.append(column)
                bins.append(cut)
                node = node * 2 + (binned[np.arange(len(y)), column[node]] > cut[node])
            leaves = RATE * np.bincount(node, gradient, 1 << DEPTH) / (np.bincount(node, curve, 1 << DEPTH) + 1)
            self.trees.append((np.concatenate(columns), np.concatenate(bins), leaves))
            score = score + leaves[node]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(cuts, c, side="left") for cuts, c in zip(self.cuts, x.T)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.first)
        for columns, bins, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = node * 2 + (binned[rows, columns[at]] > bins[at])
            score += leaves[node]
        return sigmoid(score)


def examples(text: str, most: int) -> Iterator[tuple[int, float, list[float]]]:
    """(personal, a number in [0, 1), features) of spans written into places of a text, and of base spans near them."""
    seed = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    make = Maker(seed)
    for i in range(most):
        before, span, behind, kind, personal = make()
        at = int(make.draw.integers(len(text) + 1))
        while at < len(text) and not text[at].isspace():
            at += 1
        head = text[max(0, at - AROUND) : at]
        head += ("" if not head or head[-1].isspace() else " ") + before
        window = head + span + behind + " " + text[at : at + AROUND].lstrip(" ")
        low, high = len(head) - len(before), len(head) + len(span) + len(behind)
        for c in candidates(window):
            if c[0] < high and low < c[2]:
                y = personal if c[1] == kind and abs(c[0] - len(head)) <= 1 else None
            else:
                x = features(window, c) if c[1] < len(BASE) else None
                y = None if x is None else 1 if c[3] else 0 if not any(x[k] for k in _NEAR) else None
            if y is not None:
                yield y, (seed * 31 + i * 7919 + c[0] * 104729) % 1_000_003 / 1_000_003, features(window, c)


def fit(docs: DataFrame, text: str = "text") -> tuple[Trees | None, dict[int, float]]:
    """The trees and the thresholds of the kinds that they add."""
    n = docs.count()
    share = int((1 << 20) * min(1.0, FIT_TEXTS / max(n, 1)))
    # copies of a text are drawn together and count once
    drawn = docs.select(F.col(text).alias("text")).where(F.col("text") != "").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share).groupBy("text").agg(F.lit(1).alias("one")).select("text")
    drawn = stored(drawn, "drawn")
    each = -(-EXAMPLES // max(drawn.count(), 1))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if out := [(y, key, np.array(x, np.float32).tobytes()) for t in b["text"] for y, key, x in examples(t.as_py(), each)]:
                yield dict(zip(("y", "key", "x"), map(list, zip(*out))))

    got = map_batches(drawn, run, "y int, key double, x binary").toArrow()  # bounded by EXAMPLES and what stands beside them
    forget(drawn)
    if not len(got):
        return None, {}
    y, key = got.column("y").to_numpy().astype(float), got.column("key").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), -1).astype(float)
    order = np.lexsort((*x.T, y, key))
    x, y, key = x[order], y[order], key[order]
    hidden = (x[:, : len(BASE)].any(axis=1)) & ((key * 1e4) % 1.0 < HIDDEN_PART)
    x[np.ix_(hidden, _FORMAT)] = 0
    curve = key < CURVE_PART
    if len(set(y[~curve].tolist())) < 2:
        return None, {}
    trees = Trees(x[~curve], y[~curve])
    p, thresholds = trees(x[curve]), {}
    for place in range(len(BASE), len(KINDS)):
        mine = x[curve][:, place] == 1
        order = np.argsort(-p[mine], kind="stable")
        hits, scores = y[curve][mine][order].cumsum(), p[mine][order]
        good = np.flatnonzero(hits >= PRECISION * np.arange(1, len(hits) + 1))
        if len(good):
            thresholds[place] = float(max(scores[good[-1]], 0.5))
    return trees, thresholds


class Finder:
    """All spans of a text: the base kinds', and what the trees add."""

    def __init__(self, trees: Trees | None, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def __call__(self, text: str) -> tuple[list[tuple], list[tuple]]:
        """Base spans and added spans as (start, place of the kind, end)."""
        base = sorted((s, k, e) for s, k, e, fits in base_spans(text) if fits)
        added: list[tuple] = []
        if self.thresholds:
            open_ = [c for c in candidates(text) if c[1] in self.thresholds and not any(s < c[2] and c[0] < e for s, _, e in base)]
            if open_:
                p = self.trees(np.array([features(text, c) for c in open_], float))
                for score, c in sorted(((-x, c) for x, c in zip(p, open_))):
                    if -score >= self.thresholds[c[1]] and not any(s < c[2] and c[0] < e for s, _, e in added):
                        added.append(c[:3])
        return base, sorted(added)


def written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, fitted: tuple, text: str = "text") -> DataFrame:
    """(doc_id, counts of the base kinds, base, spans): spans are written kind:start:end, in code points."""
    held = to_tasks(docs.sparkSession, fitted)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        finder = Finder(*in_task(held))
        for b in batches:
            got = [finder(t or "") for t in b[text].to_pylist()]
            yield {"doc_id": b["doc_id"], "base": [written(x) for x, _ in got], "spans": [written(x + y) for x, y in got]} | {
                f"n_{kind}": pa.array([sum(s[1] == k for s in x) for x, _ in got], pa.int64()) for k, kind in enumerate(BASE)
            }

    kind = dict(docs.dtypes)["doc_id"]
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return map_batches(docs.select("doc_id", text), run, f"doc_id {kind}, {counts}, base string, spans string")


def redact(docs: DataFrame, fitted: tuple, text: str = "text") -> DataFrame:
    """The same columns, each text with its spans replaced by [KIND]; overlapping spans become one."""
    held = to_tasks(docs.sparkSession, fitted)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        finder = Finder(*in_task(held))
        for b in batches:
            yield b | {text: [None if t is None else redacted(t, sorted(sum(finder(t), []))) for t in b[text].to_pylist()]}

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return map_batches(docs, run, schema)


def redacted(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for start, place, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[place].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op6_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = find(docs, fit(docs))
    return rows.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op6_private_spans": op6_private_spans}
ORACLES: dict[str, str] = {}
