"""Personal data by candidate gradient boosting.

Base patterns give certain spans. High-recall generators propose further, overlapping spans: written-out addresses, loosely
grouped numbers, colon-separated addresses. Boosted trees over format and context features score them, and those whose
calibrated score reaches the threshold of their kind are redacted too.

Labels need no annotation and don't copy the base patterns. Each base span of a sampled document is also rewritten in place, in its
real surroundings: once in another form of the same datum (`rewritten`, a positive) and once as something that only looks like it
(`spoiled`, a negative: wrong check digits, parts above 255, order numbers). The generators' own candidates there are
labelled by whether they are the rewritten datum. Candidates of the unchanged text are positive if they are base spans and
negative if they aren't well formed; all others are unknown and left out.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, isotonic
from .runtime import training_sample, tune

KINDS = ("email", "ip", "card", "phone")
#: Documents and candidates that trees are learned from at most; the calibrated share that a redacted candidate must reach.
SAMPLE_ROWS, SAMPLE_CANDIDATES, CERTAIN = 4_000, 40_000, 0.9
#: Rewritten and spoiled forms of each base span that is learned from.
VARIANTS = 3

Span = tuple[int, int, str]
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: it would fail or succeed just as it does from the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Left to right: a match is the longest run of local characters that ends at an @ with a domain behind it."""
    found, begin, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        while domain and start > begin and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            begin = domain.end()
            found.append((start, begin, "email"))
        at = text.find("@", max(begin, at + 1))
    return found


def base_spans(text: str | None) -> list[Span]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    text = text or ""
    found = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: The generators' patterns, and words near a span that speak for a kind.
GENERATORS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@| ?[\[({]at[\])}] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9-]{1,63}){1,5}"), re.compile(r"@|\bat\b")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])"), None),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){4,7}(?![0-9A-Fa-f:])"), re.compile(":[0-9A-Fa-f]{1,4}:")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{2,6}){2,4}(?![0-9])"), None),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ ./-][0-9]{2,4}[ ./-][0-9]{2,5}(?![0-9A-Za-z])"), None),
]
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile")}
_PHONE_CUES = re.compile("|".join(CUES["phone"]), re.IGNORECASE)
_DIGIT = re.compile("[0-9]")


def candidates(text: str | None, base: list[Span] | None = None) -> list[Span]:
    """Spans of all generators and of the base patterns, which may be given; they overlap."""
    text = text or ""
    found = set(base_spans(text) if base is None else base)
    digits = _DIGIT.search(text)
    for kind, pattern, cue in GENERATORS:
        if cue.search(text) if cue else digits:
            found |= {(m.start(), m.end(), kind) for m in pattern.finditer(text)}
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_AT, _DOT = re.compile(r" ?[\[({]at[\])}] ?| at "), re.compile(r" ?[\[({]dot[\])}] ?| dot ")


def canonical(span: str, kind: str) -> str:
    """A written-out or loosely grouped span in the form that base patterns know: '@' and '.' in e-mails, digits alone in cards and
    phones, '+' for a phone's leading 00."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", span, count=1))
    if kind == "ip":
        return span
    digits = _NOT_DIGIT.sub("", span)
    abroad = kind == "phone" and (span.startswith(("+", "00")))
    return "+" + digits.removeprefix("00") if abroad else digits


def well_formed(text: str, span: Span) -> bool:
    """Whether the canonical form has the format of its kind; sums and sizes of parts aren't looked at. ' at ' between words
    needs a written-out dot, a phone without '+' or 00 needs a cue word."""
    start, end, kind = span
    s, near = text[start:end], _near(text, span)
    form, cued = canonical(s, kind), any(w in near for w in CUES[kind])
    if kind == "email":
        plain = " at " not in s or _DOT.search(s) is not None
        return _emails(form) == [(0, len(form), "email")] and form[-2:].isalpha() and plain
    if kind == "ip":
        return form.count(".") == 3 or form.count(":") == 7
    if kind == "card":
        return 12 <= len(form) <= 19
    return 9 <= len(form.removeprefix("+")) <= 15 and (form[0] == "+" or cued)


def sound(form: str, kind: str) -> bool:
    """Whether a canonical form passes the check of its kind: Luhn sum, parts of an address; others have none."""
    if kind == "ip":
        try:
            ipaddress.ip_address(form)
        except ValueError:
            return False
    return kind != "card" or (12 <= len(form) <= 19 and luhn(form))


def _grouped(digits: str, mark: str) -> str:
    """Digits in fours, the last group of two at least."""
    cuts = [*range(0, len(digits) - 1, 4), len(digits)]
    return mark.join(digits[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def rewritten(span: str, kind: str, rng: np.random.Generator) -> tuple[str, str]:
    """(words before it, another form of the same kind of datum) that base patterns don't find."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    if kind == "email":
        local, _, domain = span.partition("@")
        at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), ("(at)", " dot "))
        return "", local[-64:] + at + dot.join(domain.split(".")[-3:])
    if kind == "ip":
        return "", ":".join(f"{x:x}" for x in rng.integers(0, 1 << 16, 8).tolist())
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        return "", _grouped(digits, pick(".", "/", "_"))
    mark = pick("-", ".", " ")
    if rng.random() < 0.3:
        return "", mark.join(("00" + digits[:-8], digits[-8:-4], digits[-4:]))
    return pick("tel ", "phone: ", "call ", "mobile "), mark.join((digits[-10:-7].rjust(3, "2"), digits[-7:-4], digits[-4:]))


def spoiled(span: str, kind: str, rng: np.random.Generator) -> tuple[str, str]:
    """(words before it, something of the same look that is no datum of the kind)."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    if kind == "email":
        return "", span.replace("@", " at ")[-100:]
    if kind == "ip":
        parts = rng.integers(0, 256, 4).tolist()
        parts[int(rng.integers(4))] = int(rng.integers(256, 1000))
        return "", pick(".".join(map(str, parts)), ":".join(f"{x:02}" for x in rng.integers(0, 60, 5).tolist()))
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        return "", _grouped(wrong, pick(".", "/", "_", " ", "-"))
    return pick("order ", "no. ", "item ", ""), pick("-", ".", " ").join((digits[-10:-7].rjust(3, "2"), digits[-7:-4], digits[-4:]))


class Taken:
    """Disjoint spans by start."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.ends, start + 1)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def _near(text: str, span: Span) -> str:
    return text[max(0, span[0] - 24) : span[0]].lower() + " " + text[span[1] : span[1] + 24].lower()


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "\"'`()[]<>" else 5


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span, as numbers."""
    start, end, kind = span
    s, near = text[start:end], _near(text, span)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    marks = [c for c in s if not c.isalnum()]
    digits = sum(groups)
    return [
        *(float(kind == k) for k in KINDS), len(s), digits, sum(c.isalpha() for c in s), len(groups), max(groups), min(groups), groups[0], groups[-1],
        len(marks), len(set(marks)), s.startswith("+"), "(" in s, "@" in s, s.count("."), s.count(" "), s.count("-"), s.count(":"),
        float(s[0]) if s[0].isdigit() else -1.0, _class(text[start - 1 : start]), _class(text[end : end + 1]),
        sum(c.isdigit() for c in near) / len(near), sum(c.isalpha() for c in near) / len(near), any(w in near for w in CUES[kind]), "=" in near[20:26], well_formed(text, span), sound(canonical(s, kind), kind),
    ]


class Selector:
    """Trees with the score that a candidate of each kind must reach."""

    def __init__(self, trees: BoostedTrees, least: dict[str, float]):
        self.trees, self.least = trees, least

    def spans(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text. An added span overlaps no base span and no better added one."""
        base = [base_spans(t) for t in texts]
        open_ = []
        for i, text in enumerate(texts):
            taken = Taken(base[i])
            open_ += [(i, c) for c in candidates(text, base[i]) if not taken.touches(c[0], c[1])]
        scores = self.trees.predict(np.array([features(texts[i], c) for i, c in open_], float)) if open_ else []
        added: dict[int, list[Span]] = {}
        beside: dict[int, Taken] = {}
        for score, i, c in sorted(((float(p), i, c) for p, (i, c) in zip(scores, open_, strict=True)), key=lambda x: (-x[0], x[1:])):
            if score >= self.least.get(c[2], np.inf) and not beside.setdefault(i, Taken([])).touches(c[0], c[1]):
                beside[i].add(c[0], c[1])
                added.setdefault(i, []).append(c)
        return [(b, sorted(b + added.get(i, []), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))) for i, b in enumerate(base)]


N_FEATURES = len(features("0", (0, 1, "card")))


def examples(doc_id: int | None, text: str | None) -> list[tuple[int, str, list[float], bool]]:
    """(start, kind, features, positive) of a document's labelled candidates, the same on every run. Changes have starts below 0."""
    text = text or ""
    base = base_spans(text)
    known, taken = set(base), Taken(base)
    out = [(c[0], c[2], features(text, c), c in known) for c in candidates(text, base) if c in known or not (taken.touches(c[0], c[1]) or (well_formed(text, c) and sound(canonical(text[c[0] : c[1]], c[2]), c[2])))]
    for n, (start, end, kind) in enumerate(base):
        rng = np.random.default_rng([(doc_id or 0) & 0xFFFFFFFF, start, n])
        for positive, made in ((True, rewritten), (False, spoiled)) * VARIANTS:
            words, form = made(text[start:end], kind, rng)
            # Features look no further than the surroundings, so the text far off needn't be copied.
            before, after = text[max(0, start - 200) : start], text[end : end + 200]
            if kind == "phone" and not positive:
                before, after = _PHONE_CUES.sub("", before), _PHONE_CUES.sub("", after)
            before += words
            changed, place = before + form + after, (len(before), len(before) + len(form), kind)
            for c in candidates(changed):
                if c[0] < place[1] and place[0] < c[1] and (c == place or not positive) and c[2] == kind and c not in base_spans(changed):
                    out.append((-1 - n, kind, features(changed, c), positive))
    return out


def _sampled(batches):
    for batch in batches:
        rows = [(i, start, kind, [float(x) for x in of], positive) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for start, kind, of, positive in examples(i, text)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.bool_()), strict=True)], ["doc_id", "start", "kind", "features", "positive"])


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_CANDIDATES, certain: float = CERTAIN) -> Selector:
    """Trees and thresholds from at most `rows` documents and `most` of their candidates. Two thirds of the documents grow trees,
    the others calibrate them, on what base patterns don't find. A kind without 20 such candidates or without both labels among
    them, or whose calibrated share never reaches `certain`, adds nothing."""
    sample = training_sample(docs, docs.where("doc_id is not null").select("doc_id").distinct(), rows)
    sample = sample.mapInArrow(_sampled, "doc_id long, start long, kind string, features array<double>, positive boolean")
    got = sample.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "kind").limit(most).toPandas()
    x = np.stack(got["features"].to_list()) if len(got) else np.empty((0, N_FEATURES))
    y, held = got["positive"].to_numpy(float), (got["doc_id"].to_numpy() // 7) % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    least = {}
    for kind in KINDS:
        of = held & (got["kind"] == kind).to_numpy() & ~((got["start"] >= 0) & got["positive"]).to_numpy()
        if of.sum() >= 20 and 0 < y[of].sum() < of.sum():
            scores = trees.predict(x[of])
            knots, share = isotonic(scores, y[of])
            if (share >= certain).any():
                # The least score seen among the certain; of scores between it and the block below nothing is known.
                first = int(np.argmax(share >= certain))
                least[kind] = float(scores[scores > knots[first - 1]].min() if first else scores.min())
    return Selector(trees, least)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def named(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _found(selector: Selector):
    def run(batches):
        for batch in batches:
            rows = []
            for base, spans in selector.spans(batch.column("text").to_pylist()):
                rows.append((*(sum(k == kind for _, _, k in base) for kind in KINDS), hashlib.sha256(named(base).encode()).hexdigest(), named(spans)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (*[pa.int64()] * 4, pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [f.split()[0] for f in FOUND.split(", ")])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, a row for every row of docs.

    Counts and digest are of the base spans; spans has all, as kind:start:end by start. A null text is empty and has no spans. Rows that
    repeat are searched each. Other columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_found(learn(docs)), FOUND)


def redacted_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with [KIND] for each span; spans that overlap become one, named after the first."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for start, stop, kind in spans:
        if start >= end:
            out += [text[at:start], f"[{kind.upper()}]"]
        end = at = max(end, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in `text`, and n_chars, if there is such a column, counted anew; all columns stay.

    Null texts stay null (n_chars too), empty ones empty; rows that repeat are redacted each. Of candidates of equal score the first by
    place, then kind, is taken. Texts are searched whole, in time that grows little faster than their length. An empty
    table stays empty.
    """
    tune(docs.sparkSession)
    selector = learn(docs)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            texts = [redacted_text(t, spans) for t, (_, spans) in zip(texts, selector.spans(texts), strict=True)]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
