"""Personal data in whole texts, with DataFrame functions only.

Base spans are the matches of four fixed patterns, found independently, leftmost and non-overlapping per kind, with the
checks of their kind. Beyond them, candidates are proposed by regex and gazetteer labelers: credentials by their own form or
as the value after a credential word, account numbers in IBAN form, identity numbers, and names after a title (English,
German, French, Spanish) or that begin with a listed given name. They get votes from regex, gazetteer and context labelers;
expectation-maximisation over the counts of vote patterns of all documents estimates what the labelers' votes are worth, and
a logistic span classifier on votes and on the span's own shape, trained on the posteriors, decides. Only the pattern
counts (at most 3^6 votes and 48 shapes for each kind) reach the driver.

Rows keep their spans beside them throughout, so that no row is joined to its spans by an id.

Offsets are code points, the end exclusive. Positions come from the lengths of the pieces between matches, by running sums
over blocks of BLOCK matches.

Defined results: null text counts as empty; repeated rows and ids repeat, each with the spans of its own text; very long
texts, and texts with very many matches, are taken whole in time linear in their length (no pattern can backtrack over more
than one run); extra columns are ignored, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _logistic
from tickloom.llm._common import cut
from tickloom.llm._labelmodel import LabelModel

BLOCK, CHUNK = 128, 4096
KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "identity", "name")
#: The fixed patterns in a form that never runs back over what it has read; a match may begin where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # Longest runs of digits with single separators, of 12 to 19 digits.
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text holds if the kind can match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"

CREDENTIAL = r"(?:token|secret|passw(?:or)?d|passphrase|api.?key|access.?key|auth|bearer|credential|private.?key)"
# Titles, and common given names in the four languages.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Mlle|M|Señor|Señora|Sr|Sra|Don|Doña"
NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica "
    "Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Steven Sandra Andrew Ashley Emily "
    "Emma Olivia Anna Maria Peter Paul Hans Klaus Ursula Wolfgang Monika Jürgen Sabine Petra Stefan Andreas Claudia Birgit "
    "Heike Dieter Günter Helga Gisela Uwe Frank Martin Katrin Lukas Leon Marie Jean Pierre Michel Philippe Nathalie Isabelle "
    "Sylvie Catherine Françoise Jacques Laurent Nicolas Camille Léa Manon Chloé Louis José Juan Carlos Ana Laura Luis Miguel "
    "Francisco Antonio Manuel Carmen Pilar Lucía Isabel Rosa Javier Diego Sofía Elena Pablo Fernando Alejandro"
).split()
GIVEN = r"(?:" + "|".join(NAMES) + r")"
WORD = r"\p{Lu}\p{Ll}++"
#: A credential word and what stands between it and its value.
PREFIX = r"(?i:" + CREDENTIAL + r")[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
CANDIDATE = (
    r"(?<![\p{L}\p{N}])(?:(?=[TSPABCtspabc])" + PREFIX + r"[^\s\"',;:=<>(){}\[\]]{6,}+"
    r"|[A-Fa-f0-9]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_.-]{10,}+"
    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|(?=\p{Lu})(?:(?:" + TITLES + r")\.? " + WORD + "(?: " + WORD + r"){0,2}"
    r"|" + GIVEN + "(?: " + WORD + r"){1,2}))(?![\p{L}\p{N}-])"
)
VOTERS, SHAPES = 6, 7


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, where a lambda would work it out for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, plus, zero: Column) -> Column:
    """What ``plus`` makes of the items before each one: in blocks, since an array that grows by one item is copied each time."""

    def before(values: Column) -> Column:
        return F.aggregate(values, F.array(zero), lambda done, x: F.concat(done, F.array(plus(F.element_at(done, -1), x))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
    local = F.transform(starts, lambda i: before(F.slice(items, i, BLOCK)))
    return let(
        local,
        lambda blocks: F.flatten(
            F.zip_with(
                blocks,
                F.slice(before(F.transform(blocks, lambda b: F.element_at(b, -1))), F.lit(1), F.size(blocks)),
                lambda b, carry: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: plus(carry, x)),
            )
        ),
    )


def located(text: Column, pattern: str, matches: Column) -> Column:
    """(text, before, start, end) of the matches of a pattern in a text, in order; before: some of what stands before it."""
    none = F.expr("cast(array() as array<struct<text:string,before:string,start:int,end:int>>)")

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda x: x["gap"] + x["length"])
        return F.zip_with(
            parts,
            let(lengths, lambda n: running(n, lambda a, b: a + b, F.lit(0))),
            lambda x, at: F.struct(
                x["text"].alias("text"), x["before"].alias("before"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["length"]).alias("end")
            ),
        )

    def parts(found: Column, gaps: Column) -> Column:
        return F.transform(
            found,
            lambda m, i: F.struct(
                m.alias("text"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("length"),
                F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(31)).alias("before"),
            ),
        )

    def found(m: Column) -> Column:
        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda gaps: let(parts(m, gaps), placed))).otherwise(none)

    return let(matches, found)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit: every second digit from the end counts by the digits of its double."""
    back = F.reverse(number)
    doubled = F.translate(F.regexp_replace(back, ".(.?)", "$1"), "0123456789", "0246813579")
    n = F.char_length(number)

    def total(both: Column) -> Column:
        return sum(((n - F.char_length(F.replace(both, F.lit(str(d)), F.lit("")))) * d for d in range(2, 10)), n - F.char_length(F.replace(both, F.lit("1"), F.lit(""))))

    return let(F.concat(F.regexp_replace(back, "(.).?", "$1"), doubled), total) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.char_length(digits(m)).between(9, 15)
    return F.lit(True)


def remainder(number: Column) -> Column:
    """The remainder modulo 97 of an account number in IBAN form; 1 for a valid one."""
    plain = F.replace(number, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def votes(kind: Column, found: Column, before: Column) -> Column:
    """Votes (0 none, 1 some, 2 strong) of the labelers on a candidate; the last speaks against it."""
    low = F.lower(before)
    pick = lambda strong, some: F.when(strong, 2).when(some, 1).otherwise(0)
    return F.array(
        pick(  # shape
            found.rlike(r"^(?:[A-Fa-f0-9]{32}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64,}|AKIA.*|gh._.*|sk-.*|eyJ.*)$")
            | (kind == "identity") & ~found.rlike("^(?:000|666|9)")
            | F.when(kind == "account", remainder(found) == 1).otherwise(False)
            | (kind == "name") & found.rlike(r"^(?:" + TITLES + r")\b"),
            kind.isin("account", "name"),
        ),
        pick(found.rlike("[0-9]") & found.rlike(r"\p{L}"), found.rlike("[0-9]")),
        pick((kind == "name") & found.rlike(r"(?:^| )" + GIVEN + r"(?: |$)"),
             (kind == "account") & found.rlike("^(?:DE|FR|ES|GB|IT|NL|AT|BE|CH|LU|PT|PL|IE|DK|SE|NO|FI|CZ|GR|HU|RO)")),
        pick(low.rlike(CREDENTIAL + r"\W{0,6}$"), low.rlike(CREDENTIAL) | low.rlike(r"iban|account|konto|compte|cuenta|ssn|social|contact|dear|name")),
        pick(low.rlike(r"[=:]\s*[\"']?$"), low.rlike(r"[\"'(]$")),
        pick(low.rlike(r"(?:sha.?\d*|md5|commit|digest|checksum|isbn|revision|hash)\W{0,4}$"), low.rlike(r"version|figure|section")),
    )


def shape(found: Column) -> Column:
    """What a span looks like by itself, 0 or 1 each: its length, share of digits, mixed case, and words."""
    n = F.char_length(found)
    share = F.char_length(digits(found)) / n
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.array(
        flag((n >= 8) & (n < 16)), flag((n >= 16) & (n < 32)), flag(n >= 32), flag((share > 0) & (share < 0.5)), flag(share >= 0.5),
        flag(found.rlike(r"\p{Ll}") & found.rlike(r"\p{Lu}")), flag(found.contains(" ")),
    )


def spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, and as a struct ``_pii`` the base (start, kind number, end) and candidates (start, end, kind, votes, shape) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    numbers = text.rlike("[0-9]")

    def valid(i: int, k: str) -> Column:
        can = (F.contains(text, F.lit(HINTS[k])) if HINTS[k] else F.lit(True)) & (numbers | F.lit(k == "email"))
        matches = F.when(can, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
        found = F.filter(located(text, PATTERNS[k], matches), lambda x: passes(k, x["text"]))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    base = [valid(i, k) for i, k in enumerate(KINDS)]

    def candidate(x: Column) -> Column:
        kind = (
            F.when(x["text"].rlike(r"^(?:(?:" + TITLES + r")\b|" + GIVEN + " )"), "name")
            .when(x["text"].rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "identity")
            .when(x["text"].rlike("^[A-Z]{2}[0-9]{2}") & ~x["text"].rlike("^[A-F0-9]{32,}$"), "account")
            .otherwise("secret")
        )
        # The value of a credential word, without the word.
        value = F.when(kind == "secret", F.regexp_replace(x["text"], "^" + PREFIX, "")).otherwise(x["text"])

        def judged(v: Column) -> Column:
            ahead = F.char_length(x["text"]) - F.char_length(v)
            before = F.right(F.concat(x["before"], F.left(x["text"], ahead)), F.lit(31))
            return F.struct(
                (x["start"] + ahead).alias("start"), x["end"].alias("end"), kind.alias("kind"), votes(kind, v, before).alias("votes"), shape(v).alias("shape")
            )

        return let(value, judged)

    more = F.transform(located(text, CANDIDATE, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))), candidate)
    found = let(F.array_sort(F.concat(*base)), lambda b: let(more, lambda m: F.struct(b.alias("base"), untouched(b, m).alias("more"))))
    return docs.select(*keep, found.alias("_pii"))


def untouched(base: Column, more: Column) -> Column:
    """The candidates that no base span touches: such a one is known already."""
    far = F.lit(2**31 - 1)
    entry = lambda x, own, kind, vote, look: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), kind.alias("kind"), vote.alias("votes"), look.alias("shape")
    )
    ints = F.expr("cast(null as array<int>)")
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda x: entry(x, 0, F.lit(None).cast("string"), ints, ints)),
            F.transform(more, lambda x: entry(x, 1, x["kind"], x["votes"], x["shape"])),
        )
    )

    def judged(all_spans: Column) -> Column:
        ends = F.transform(all_spans, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0))
        starts = F.reverse(F.transform(all_spans, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far)))
        reach = let(ends, lambda e: running(e, F.greatest, F.lit(0)))
        after = F.reverse(let(starts, lambda s: running(s, F.least, far)))
        marked = F.zip_with(
            F.zip_with(all_spans, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), after, lambda x, a: F.struct(x["x"].alias("x"), (
                (x["x"]["own"] == 1) & (x["reach"] <= x["x"]["start"]) & (a >= x["x"]["end"])).alias("free")),
        )
        fields = ("start", "end", "kind", "votes", "shape")
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: F.struct(*[x["x"][c].alias(c) for c in fields]))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(both, judged))


def classifier(held: DataFrame) -> dict[str, np.ndarray]:
    """Coefficients of the span classifier by kind (2 x VOTERS, SHAPES and the intercept), from all candidates' votes and shapes."""
    # The outer form, as the plain one has the optimizer work out all candidates once more for a filter.
    table = (
        held.select(F.explode_outer("_pii.more").alias("m"))
        .groupBy(F.col("m.kind").alias("kind"), F.col("m.votes").alias("votes"), F.col("m.shape").alias("shape")).count().collect()
    )
    out = {}
    for kind in ADDED:
        own = [r for r in table if r.kind == kind]
        if not own:
            continue
        patterns = np.array([r.votes for r in own], int)
        counts = np.zeros((len(own), 3))
        counts[:, 0] = [r["count"] for r in own]
        # First guess: shape, gazetteer and context together speak for a span, the last labeler against it.
        speaks = [0.6, 0.0, 0.6, 0.6, 0.4, -0.8] if kind == "name" else [0.3, 0.1, 0.3, 0.6, 0.4, -0.8]
        model = LabelModel(patterns, counts, np.array(speaks), prior=0.5)
        x = np.concatenate([patterns == 1, patterns == 2, np.array([r["shape"] for r in own]) == 1], axis=1).astype(float)
        out[kind] = _logistic.fit(x, model.post, counts.sum(1), ridge=0.05)
    return out


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id), base and all: arrays of (start, kind number, end), sorted; numbers follow KINDS + ADDED.

    The rows stand in the shared folder between the two steps, so that texts are searched once.
    """
    keep = ["doc_id"] if keep is None else keep
    held = cut(spans(docs, keep))
    learned = classifier(held)

    def accepted(x: Column) -> Column:
        inputs = [(F.get(x["votes"], F.lit(i)) == k).cast("double") for k in (1, 2) for i in range(VOTERS)]
        inputs += [F.get(x["shape"], F.lit(i)).cast("double") for i in range(SHAPES)]
        score = F.lit(0.0)
        for kind, beta in learned.items():
            score = F.when(x["kind"] == kind, _logistic.score(inputs, beta)).otherwise(score)
        return score >= 0.5

    number = lambda kind: F.array_position(F.array(*map(F.lit, ADDED)), kind).cast("int") + len(KINDS) - 1

    def result(p: Column) -> Column:
        added = F.transform(
            F.filter(p["more"], accepted),
            lambda x: F.struct(x["start"].alias("start"), number(x["kind"]).alias("kind"), x["end"].alias("end")),
        )
        return F.struct(p["base"].alias("base"), F.array_sort(F.concat(p["base"], added)).alias("all"))

    return held.select(*keep, let(F.col("_pii"), result).alias("_pii")).select(*keep, "_pii.base", "_pii.all")


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of ``detect``'s rows."""
    n = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"),
    )


def redact(text: Column, found: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, *ADDED)])

    def part(chunks: Column, start: Column, end: Column) -> Column:
        """A part of the text from its chunks, so that no search for a place runs over more than one of them."""
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, end - start)

    def replaced(chunks: Column, spans: Column) -> Column:
        reach = let(F.transform(spans, lambda x: x["end"]), lambda e: running(e, F.greatest, F.lit(0)))
        heads = F.filter(F.zip_with(spans, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), lambda x: x["x"]["start"] >= x["reach"])
        texts = F.transform(heads, lambda h: F.concat(part(chunks, h["reach"], h["x"]["start"]), F.get(names, h["x"]["kind"])))
        tail = part(chunks, F.array_max(F.transform(spans, lambda x: x["end"])), F.aggregate(chunks, F.lit(0), lambda n, c: n + F.char_length(c)))
        return F.concat(F.array_join(texts, ""), tail)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(found) > 0, let(chunks, lambda c: let(found, lambda s: replaced(c, s)))).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the personal data in their texts replaced, and n_chars, where there is one, to match.

    Inside, columns go by their place, so that no name of the input's can clash.
    """
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    held = detect(docs.toDF(*names), names)
    changed = F.size("all") > 0
    out = held.withColumn("text", F.when(changed, redact(F.col("text"), F.col("all"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(changed, F.char_length("text")).otherwise(F.col(n)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names).toDF(*docs.columns)
