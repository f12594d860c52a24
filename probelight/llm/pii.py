"""Personal data by weak supervision (DataFrame and SQL functions only).

Four base kinds are found by fixed patterns. Looser candidates (secrets, obfuscated e-mail addresses, phone numbers
without a country code, names of persons, postal addresses) are put to labelers: a strict regex, a gazetteer, cue words
before the span and counter-cues around it. The gazetteer is a fixed list for each kind and, if given, a table (kind,
entry) of up to MOST_ENTRIES entries a kind, which is checked; entries are compared with whole words, domain labels or
beginnings. Votes are counted per pattern of votes; expectation-maximisation over these few counts estimates each
labeler's reliability without labels, and a logistic span classifier is fitted to the resulting probabilities and
compiled into a column expression. Accepted candidates are added; base spans always stay.

Cases: a null or empty text has no spans; texts of any length are searched whole and so are spans of any length;
spans of one kind do not overlap, the leftmost of equal starts wins; repeated rows give repeated rows; other columns
may have any names; an empty table gives an empty table and a classifier that accepts nothing. Null and empty entries
of a gazetteer table and entries of other kinds are passed over, repeated ones count once. Positions are code points,
end exclusive.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "email_hidden", "phone_local", "name", "address")
KINDS = BASE + EXTRA

# The base patterns, in a form that the regex engine runs in linear time and without recursion: each run of
# characters is taken once and for all, and a match begins where a run begins or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{16,}+",
    "email_hidden": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|@)[\])] ?[A-Za-z0-9-]++(?: ?[\[(](?:dot|\.)[\])] ?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9A-Za-z+.,-])\(?0?[0-9]{2,4}\)?[ /-][0-9]{3,4}[ -][0-9]{3,5}(?![0-9A-Za-z.,-])",
}
STRICT = {
    # Keys of known shapes, digests, and long runs of mixed letters and digits without a plain word between slashes.
    "secret": r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{16,}|[0-9A-F]{16,}|eyJ[A-Za-z0-9_-]{13,}"
    r"|(?!.*(?:^|/)[a-z]{3,}(?:/|$))(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_/+-]{32,}={0,2})$",
    "email_hidden": r"(?i)[\[(](?:dot|\.)[\])] ?(?:com|org|net|edu|gov|info|io|de|fr|es|co|uk|eu)$",
    "phone_local": r"^\([0-9]{2,4}\)[ /-]|^0[0-9]",
    # A name with a title, an address with a postcode; without them neither for nor against.
    "name": r"^(?:{titles})\.? ",
    "address": r"[, ](?:[A-Z]{1,2}-)?[0-9]{4,5} \p{Lu}\p{L}+$",
}
SILENT = ("name", "address")  # kinds whose strict labeler does not vote against
# Fixed word lists.
CUES = {
    "secret": "password passwd pwd token secret key apikey api_key bearer credential passwort clave contraseña jeton",
    "email_hidden": "mail email e-mail contact write reach correo courriel kontakt",
    "phone_local": "phone tel telephone call mobile cell fax telefon handy téléphone teléfono móvil",
    "name": "name dear regards sincerely signed attn contact patient customer employee nom nombre herrn cher chère estimado estimada",
    "address": "address residence at ship deliver home adresse wohnhaft anschrift dirección domicilio domicile",
}
COUNTER = "isbn issn version order invoice page pages volume vol doi sha commit checksum figure table saint university museum"
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sra"
GAZETTEER = {
    # Beginnings of issued keys.
    "secret": "AKIA ASIA AGPA AIDA AROA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_live_ sk_test_ pk_live_ pk_test_ rk_live_ whsec_ eyJ xoxa- xoxb- xoxp- xoxr- xoxs- AIza ya29 npm_ pypi- dop_v1_ shpat_ SG. hf_ key- EAACEdEose0cBA",
    # Mail services.
    "email_hidden": "gmail googlemail yahoo ymail hotmail outlook live msn aol icloud me mac proton protonmail gmx web t-online freenet orange laposte free wanadoo mail yandex zoho fastmail tutanota example posteo telefonica hotmail libero",
    # Beginnings of numbers as they are dialled within a country.
    "phone_local": "(0 ( 0 1-800 1-888 1-877 800 888 877 900",
    # Given names that are no common words.
    "name": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Hans Peter Klaus Wolfgang Jürgen Stefan Andreas Thorsten Ursula Monika Sabine Petra Heike Anna Jean Pierre Michel Philippe Jacques Nicolas François Marie Nathalie Isabelle Sylvie Catherine José Antonio Manuel Francisco Juan Javier Carlos Miguel María Carmen Ana Isabel Dolores Pilar Teresa",
    # Words for streets, as they stand after, in or before a street's name.
    "address": "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Square Terrace Way straße strasse str. allee gasse platz weg rue avenue boulevard impasse chemin quai Calle Avenida Plaza Paseo",
}
MOST_ENTRIES = 2_000
LABELERS = ("strict", "gazetteer", "cue", "counter")
ACCEPT = 0.5
CONTEXT = 32  # characters before a candidate in which cue words count

Lists = dict[str, list[str]]


def read_gazetteer(table: DataFrame | None = None) -> Lists:
    """The entries of each kind: the fixed lists and those of a table (kind, entry), whose size is checked first."""
    lists = {kind: words.split() for kind, words in GAZETTEER.items()}
    if table is not None:
        entries = table.where(F.col("kind").isin(*EXTRA) & (F.trim("entry") != "")).select("kind", F.trim("entry").alias("entry")).distinct()
        for kind, n in entries.groupBy("kind").count().collect():
            if n > MOST_ENTRIES:
                raise ValueError(f"the gazetteer has {n} entries of kind {kind}; at most {MOST_ENTRIES} are taken")
        for kind, entry in entries.orderBy("kind", "entry").collect():
            lists[kind].append(entry)
    return {kind: list(dict.fromkeys(words)) for kind, words in lists.items()}


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def candidate_patterns(lists: Lists) -> dict[str, str]:
    """Patterns of the looser kinds. A name begins with a title or a given name, an address has a number and a word for a street."""
    word = r"(?:\p{Lu}['’])?\p{Lu}(?=\p{L}*\p{Ll})\p{L}++(?:-\p{Lu}\p{L}++)?+"
    start, end = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    streets = _any(lists["address"])
    town = r"(?:,? (?:[A-Z]{1,2}-)?[0-9]{4,5} \p{Lu}\p{L}++)?+"
    name = rf"(?=\p{{Lu}}){start}(?:(?:{_any(TITLES.split())})\.? {word}|(?:{_any(lists['name'])})(?: \p{{Lu}}\.)? {word})(?: {word})?"
    forms = (
        rf"[0-9]{{1,5}}[A-Za-z]? (?:\p{{Lu}}\p{{L}}*+\.? ){{1,4}}(?:{streets}){end}",
        rf"[0-9]{{1,5}},? (?:{streets}) (?:(?:de|du|des|la|le|les) ){{0,2}}\p{{Lu}}\p{{L}}++",
        rf"\p{{Lu}}\p{{L}}*(?:{streets}) [0-9]{{1,4}}[a-z]?{end}",
        rf"(?:{streets})(?: (?:de|del|la|las|los|\p{{Lu}}\p{{L}}++)){{1,5}},? [0-9]{{1,4}}{end}",
    )
    address = rf"(?=[0-9\p{{Lu}}]){start}(?:{'|'.join(forms)}){town}"
    return CANDIDATES | {"name": name, "address": address}


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, emit, after, kind: str) -> Column:
    """The values that emit(at, item) gives along an array, where `at` starts at 0 and after(at, item) follows it.

    Items are taken in blocks of about the root of their number, so that arrays are copied n ** 1.5 times at most, not
    n ** 2. The result has the last `at` and the values.
    """
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def scan(v: Column) -> Column:
        every, block = v["items"], v["block"]
        return F.aggregate(
            F.sequence(F.lit(0), F.ceil(F.size(every) / block).cast("int") - 1),
            state(F.lit(0), F.array().cast(f"array<array<{kind}>>")),
            lambda a, k: F.aggregate(
                F.slice(every, k * block + 1, block),
                state(a["at"], F.array().cast(f"array<{kind}>")),
                lambda c, x: state(after(c["at"], x), F.concat(c["out"], F.array(emit(c["at"], x)))),
                lambda c: state(c["at"], F.concat(a["out"], F.array(c["out"]))),
            ),
            lambda a: state(a["at"], F.flatten(a["out"])),
        )

    none = state(F.lit(0), F.array().cast(f"array<{kind}>"))
    block = lambda v: F.ceil(F.sqrt(F.size(v))).cast("int")
    return _let(items, lambda v: F.when(F.size(v) > 0, _let(F.struct(v.alias("items"), block(v).alias("block")), scan)).otherwise(none))


def _located(text: Column, kind: str, pattern: str, found: Column) -> Column:
    """Matches of a pattern with their places and the CONTEXT characters before them, as far as the match before.

    The pieces between matches give every match its start and what stands before it, so the text is gone through once.
    """
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    earlier = F.concat(F.array(F.lit("")), F.slice(found, 1, F.size(found) - 1))
    context = F.zip_with(earlier, gaps, lambda m, g: F.substring(F.concat(m, g), -CONTEXT, CONTEXT) if kind in EXTRA else F.lit(""))
    sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    starts = _running(sizes, lambda at, x: at + x["g"], lambda at, x: at + x["g"] + x["m"], "int")["out"]
    placed = F.zip_with(starts, found, lambda at, m: F.struct(F.lit(kind).alias("kind"), at.alias("s"), (at + F.length(m)).alias("e"), m.alias("x")))
    seen = F.zip_with(placed, context, lambda p, b: F.struct(*[p[c].alias(c) for c in ("kind", "s", "e", "x")], b.alias("b")))
    return F.when(F.size(found) > 0, seen).otherwise(F.array().cast("array<struct<kind:string,s:int,e:int,x:string,b:string>>"))


def _apart(size: Column, base: Column, found: Column) -> Column:
    """The found spans of one kind that touch no base span, from one look along all of them from each end."""
    mark = lambda own: lambda p: F.struct(p["s"].alias("s"), F.lit(own).alias("own"), p["e"].alias("e"), p["kind"].alias("kind"), *[(p[c] if own else F.lit("")).alias(c) for c in ("x", "b")])
    after = lambda edge: lambda at, p: F.when(p["own"] == 0, F.greatest(at, edge(p))).otherwise(at)

    def free(items: Column) -> Column:
        left = _running(items, lambda at, p: at > p["s"], after(lambda p: p["e"]), "boolean")["out"]
        right = F.reverse(_running(F.reverse(items), lambda at, p: at > size - p["e"], after(lambda p: size - p["s"]), "boolean")["out"])
        alone = F.zip_with(F.zip_with(left, right, lambda a, b: a | b), items, lambda t, p: F.when((p["own"] == 1) & ~t, F.struct(*[p[c].alias(c) for c in ("kind", "s", "e", "x", "b")])))
        return F.filter(alone, lambda p: p.isNotNull())

    def kept(v: Column) -> Column:
        items = F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(v, mark(1))))
        return F.when((F.size(v) == 0) | (F.size(base) == 0), v).otherwise(_let(items, free))

    return _let(found, kept)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, d.substr(i, F.lit(1)).cast("int")).otherwise(F.pmod(d.substr(i, F.lit(1)).cast("int") * 2, F.lit(10)) + F.when(d.substr(i, F.lit(1)) >= "5", 1).otherwise(0)),
    )
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return x.rlike(rf"^(?:{part.replace('0*+', '0*')})(?:\.(?:{part.replace('0*+', '0*')})){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _votes(p: Column, lists: Lists) -> Column:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 none."""
    before = F.lower(p["b"])

    def by_kind(make) -> Column:
        out = F.lit(0)
        for kind in EXTRA:
            out = F.when(p["kind"] == kind, make(kind)).otherwise(out)
        return out

    words = lambda s: _any(s.split())
    listed = {k: _any(lists[k]) for k in EXTRA}
    begins = {k: rf"^(?:{listed[k]})" for k in ("secret", "phone_local")}
    whole = {
        # A label of the domain, but for the last one.
        "email_hidden": rf"(?i)[\])] ?(?:{listed['email_hidden']})(?= ?[\[(](?:dot|\.))",
        "name": rf"^(?:(?:{words(TITLES)})\.? )?(?:{listed['name']})(?!\p{{L}})",
        "address": rf"(?:{listed['address']})(?!\p{{L}})",
    }
    strict = by_kind(lambda k: F.when(p["x"].rlike(STRICT[k].replace("{titles}", words(TITLES))), 1).otherwise(0 if k in SILENT else -1))
    gazetteer = by_kind(lambda k: F.when(p["x"].rlike((begins | whole)[k]), 1).otherwise(0))
    cue = by_kind(lambda k: F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{words(CUES[k])})[^\p{{L}}]{{1,8}}$"), 1).otherwise(0))
    counter = F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{words(COUNTER)})[^\p{{L}}]{{1,8}}$"), -1).otherwise(0)
    return F.struct(strict.alias("strict"), gazetteer.alias("gazetteer"), cue.alias("cue"), counter.alias("counter"), F.least((p["e"] - p["s"]) / 16, F.lit(4)).cast("int").alias("size"))


def find_candidates(docs: DataFrame, *keep: str, lists: Lists | None = None) -> DataFrame:
    """The kept columns, base: array<kind,s,e>, and candidates: array<kind,s,e,votes>; candidates that touch a base span are left out."""
    lists = lists or read_gazetteer()
    text = F.coalesce(F.col("text"), F.lit(""))
    # Texts without any digit, @ or bracket are most of them; one cheap look spares them the other patterns.
    looked = docs.select(*keep, text.alias("_text"), text.rlike("[0-9]").alias("_digit"), text.contains("@").alias("_at"), text.rlike(r"[\[(](?i:at|@)[\])]").alias("_hidden"))
    need = {"email": F.col("_at"), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": F.col("_digit") & F.col("_text").contains("+"), "secret": F.col("_digit"), "email_hidden": F.col("_hidden"), "phone_local": F.col("_digit"), "name": F.lit(True), "address": F.col("_digit")}
    every = PATTERNS | candidate_patterns(lists)
    # The matches are a projection of their own, so that each pattern is searched once a text.
    matched = looked.select(*keep, "_text", *[F.when(need[k], F.regexp_extract_all("_text", F.lit(every[k]), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"_{k}") for k in KINDS])
    bare = lambda a: F.transform(a, lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e")))
    place = lambda k: _located(F.col("_text"), k, every[k], F.col(f"_{k}"))
    kept = lambda k: F.filter(place(k), lambda p: _valid(k, p["x"]))
    base = matched.withColumn("base", F.concat(*[bare(kept(k)) for k in BASE])).withColumn("_extra", F.concat(*[place(k) for k in EXTRA])).withColumn("_size", F.length("_text"))
    free = F.concat(*[_apart(F.col("_size"), F.col("base"), F.filter("_extra", lambda p: p["kind"] == k)) for k in EXTRA])  # noqa: B023
    voted = F.transform(free, lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e"), _votes(p, lists).alias("votes")))
    return base.select(*keep, "base", F.when(F.size("_extra") > 0, voted).otherwise(F.array().cast(voted_type())).alias("candidates"))


def voted_type() -> str:
    return "array<struct<kind:string,s:int,e:int,votes:struct<strict:int,gazetteer:int,cue:int,counter:int,size:int>>>"


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights over votes, kind and size; `column` compiles them for a candidate struct."""

    weights: dict[str, float]

    def column(self, p: Column) -> Column:
        z = F.lit(self.weights.get("bias", 0.0))
        for name in LABELERS:
            z = z + p["votes"][name].cast("double") * F.lit(self.weights.get(name, 0.0))
        for kind in EXTRA:
            z = z + F.when(p["kind"] == kind, F.lit(self.weights.get(f"kind={kind}", 0.0))).otherwise(0.0)
        for size in range(5):
            z = z + F.when(p["votes"]["size"] == size, F.lit(self.weights.get(f"size={size}", 0.0))).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def vote_counts(candidates: DataFrame) -> list[Row]:
    """How often each pattern of kind, votes and size occurs: at most 5 * 3**4 * 5 rows, however many documents."""
    p = F.col("p")
    return candidates.select(F.explode("candidates").alias("p")).groupBy(p["kind"].alias("kind"), *[p["votes"][n].alias(n) for n in (*LABELERS, "size")]).count().collect()


def estimate(rows: list[Row], rounds: int = 40) -> list[float]:
    """Expectation-maximisation: the probability that each pattern of votes is personal data.

    Given the class, a labeler votes for, against or not at all, independently of the others; the starting point
    is that votes are right more often than not.
    """
    belief = [1 / (1 + math.exp(-1.2 * sum(r[n] for n in LABELERS))) for r in rows]
    for _ in range(rounds):
        total = sum(r["count"] for r in rows) or 1
        share = (sum(b * r["count"] for b, r in zip(belief, rows, strict=True)) + 1) / (total + 2)
        table = {}
        for n in LABELERS:
            for v in (-1, 0, 1):
                yes = sum(b * r["count"] for b, r in zip(belief, rows, strict=True) if r[n] == v)
                no = sum((1 - b) * r["count"] for b, r in zip(belief, rows, strict=True) if r[n] == v)
                # Dirichlet prior: a vote is right rather than wrong with odds of 3 to 1.
                table[n, v] = (yes + (3, 2, 1)[1 - v], no + (3, 2, 1)[1 + v])
        sums = {n: [sum(table[n, v][c] for v in (-1, 0, 1)) for c in (0, 1)] for n in LABELERS}
        for i, r in enumerate(rows):
            odds = math.log(share / (1 - share))
            for n in LABELERS:
                yes, no = table[n, r[n]]
                odds += math.log(yes / sums[n][0]) - math.log(no / sums[n][1])
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def fit_classifier(rows: list[Row], steps: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> SpanClassifier:
    """Logistic regression on the estimated probabilities, over the counted patterns."""
    belief = estimate(rows)
    total = sum(r["count"] for r in rows)
    if not total:
        return SpanClassifier({"bias": -9.0})

    def features(r: Row) -> dict[str, float]:
        return {"bias": 1.0, f"kind={r['kind']}": 1.0, f"size={r['size']}": 1.0} | {n: float(r[n]) for n in LABELERS if r[n]}

    shown = [(features(r), b, r["count"] / total) for r, b in zip(rows, belief, strict=True)]
    weights: dict[str, float] = {}
    for _ in range(steps):
        slope: dict[str, float] = {}
        for x, b, share in shown:
            off = share * (1 / (1 + math.exp(-sum(weights.get(k, 0.0) * v for k, v in x.items()))) - b)
            for k, v in x.items():
                slope[k] = slope.get(k, 0.0) + off * v
        for k, g in slope.items():
            weights[k] = weights.get(k, 0.0) - rate * (g + shrink * weights.get(k, 0.0))
    return SpanClassifier(weights)


def find_pii(docs: DataFrame, *keep: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """The kept columns, `base` and `spans`: arrays of (kind, s, e), each by kind as listed, then start.

    A kept column named base or spans gives way to the result.
    """
    kept = [c for c in keep if c not in ("base", "spans")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    found = materialize(find_candidates(docs.select(row.alias("_row"), "text"), "_row", lists=read_gazetteer(gazetteer)), "pii")
    model = fit_classifier(vote_counts(found))
    bare = F.transform(F.filter("candidates", lambda p: model.column(p) >= ACCEPT), lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e")))
    return found.select(*[F.col("_row")[c].alias(c) for c in kept], "base", F.concat("base", bare).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["s"].cast("string"), p["e"].cast("string"))), ",")


def redact(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    All other columns, whatever their names, come back as they were.
    """
    found = find_pii(docs.select(F.struct("*").alias("row"), "text"), "row", "text", gazetteer=gazetteer)
    ordered = F.array_sort(F.transform("spans", lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), p["kind"].alias("kind"))))
    piece = lambda at, p: F.when(p["s"] >= at, F.concat(F.substring(F.col("text"), at + 1, p["s"] - at), F.lit("["), F.upper(p["kind"]), F.lit("]"))).otherwise("")
    pieces = _running(ordered, piece, lambda at, p: F.greatest(at, p["e"]), "string")
    merged = F.transform(F.array(pieces), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))[0]
    text = F.when(F.size("spans") > 0, merged).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
