"""Personal data in texts: base patterns, and boosted trees that select among high-recall candidates. Spans are found,
described, scored and selected by built-in functions alone."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, threshold

#: Kinds in the order of results: those that have a base pattern, then those that only candidates have.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "iban", "key", "id", "birth", "address")
#: The base patterns. Each begins where a run of its first class begins, or where the last match ended, and keeps what
#: it took: this finds the same matches as the plain pattern, in time linear in the text and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Candidate generators: kind and pattern. They overlap one another and the base matches, and take much that isn't personal.
GENERATORS = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\s?[\[({<]\s?at\s?[\])}>]\s?[a-z0-9-]{1,63}+(?:\s?(?:\.|[\[({<]\s?dot\s?[\])}>])\s?[a-z0-9-]{2,63}+){1,4}+"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ at [a-z0-9-]{1,63}+(?: dot [a-z0-9-]{2,63}+){1,4}+"),
    ("ip", r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}+:{1,2}){2,7}+[0-9a-f]{1,4}+(?![0-9a-z:])"),
    ("card", r"(?<![0-9])[0-9]{4}[._/\x20-]{1,3}[0-9]{4}[._/\x20-]{1,3}[0-9]{4}[._/\x20-]{1,3}[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]{1,2}[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])00[1-9][0-9]{0,2}[\x20()./-]{1,2}[0-9][0-9\x20()./-]{5,16}[0-9](?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}(?:[\x20-]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("key", r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{16,256}+={0,2}(?![A-Za-z0-9+/_=-])"),
    ("key", r"(?i)(?<![a-z0-9_])(?:password|passwort|passwd|passphrase|pwd)[\"']?\x20?[:=]\x20?[\"']?[^\s\"'<>]{4,64}"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("id", r"(?<![A-Za-z0-9])(?:[A-Z]{1,2}[\x20]?[0-9]{6,9}[A-Z]?|[0-9]{8}-?[A-Z]|[0-9]{11})(?![A-Za-z0-9])"),
    ("birth", r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?![0-9/-])"),
    ("address", r"(?<![0-9A-Za-z.])[0-9]{1,5}[a-z]?,?\x20(?:[A-Z][a-z]{1,20}\.?\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square)(?![A-Za-z])"),
    ("address", r"(?<![A-Za-z])(?:[A-Z][a-zäöüß]{2,25}(?:straße|strasse|str\.|weg|platz|allee)|(?:[Rr]ue|[Cc]alle|[Aa]venue|[Aa]venida)(?:\x20[A-Za-zà-ÿ]{1,20}){1,4})\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z])"),
)
#: A text without any of these has no candidate.
GENERATOR_NEEDS = r"(?i)[0-9]|[\[({<]\s?at\s?[\])}>]| at [a-z0-9-]{1,63}+ dot |[a-f]:{1,2}[a-f]{1,4}:|pass|pwd"
#: Words before a candidate that speak for its kind, and words that speak for something else.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|peer|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|telefon|portable)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|bic)\b",
    "key": r"(?i)(?:\b|_)(?:token|secret|pass(?:word|wd|phrase)?|pwd|key|apikey|auth|bearer|credentials?)(?:\b|_)",
    "id": r"(?i)\b(?:ssn|social|passport|passeport|national|tax|ausweis|dni|nif|identity|licen[cs]e|insurance)\b",
    "birth": r"(?i)\b(?:born|birth|dob|birthday|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento)\b",
    "address": r"(?i)\b(?:address|lives?|living|street|anschrift|adresse|home|moved|wohnt|habite|domicilio|delivered?)\b",
    "other": r"(?i)\b(?:isbn|version|order|invoice|ref|reference|serial|part|section|page|date|score|id|build|rev|lot|mac|sha\d*|md5|digest|commit|hash|checksum|updated|published|released|etag|model)\b",
}
#: Characters before a candidate that count as its context; the context begins anew behind a match of the same generator.
CONTEXT = 40
#: Labelled lines the trees are fitted on, and the share of true ones that the selected of a kind must reach on those set aside.
TRAIN_LINES, PRECISION = 8000, 0.98
SPAN = "array<struct<start:int,end:int,hit:string,before:string>>"
#: Matches that one inner loop adds up; loops over blocks keep long lists of matches from costing their square.
BLOCK = 64


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def spans(matches: Column, gaps: Column) -> Column:
    """Start, end, text of each match, in code points, and the end of the gap before it: what stands between matches gives
    the distances. Sums run over blocks of matches first, so the cost is linear."""
    none = F.array().cast(SPAN)

    def size(x: Column) -> Column:
        return F.length(x["gap"]) + F.length(x["hit"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        row = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"))
        return F.struct(F.concat(acc["out"], F.array(row)).cast(SPAN).alias("out"), (acc["at"] + size(x)).alias("at"))

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + size(x)))
        zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
        starts = F.aggregate(totals, zero, lambda acc, n: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + n).alias("at")), lambda acc: acc["out"])
        own = lambda z: F.aggregate(z["block"], F.struct(none.alias("out"), z["start"].alias("at")), step, lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("start")), own))

    def blocks_of(both: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int")), lambda b: F.slice(both, b * BLOCK + 1, F.lit(BLOCK)))

    both = F.arrays_zip(matches.alias("hit"), F.slice(gaps, 1, F.size(matches)).alias("gap"))
    return F.when(F.size(matches) > 0, _bound(both, lambda x: _bound(blocks_of(x), placed))).otherwise(none)


def _found(df: DataFrame, patterns: dict[str, str], needed: dict[str, Column]) -> DataFrame:
    """A column of spans for each pattern, where the text has what is needed."""
    none = F.array().cast("array<string>")
    df = df.select("*", *(F.when(needed[k], F.regexp_extract_all("text", F.lit(p), 0)).otherwise(none).alias(f"m_{k}") for k, p in patterns.items()))
    gaps = (F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"g_{k}") for k, p in patterns.items())
    df = df.select("*", *gaps)
    made = (spans(F.col(f"m_{k}"), F.col(f"g_{k}")).alias(f"s_{k}") for k in patterns)
    return df.select("*", *made).drop(*(f"{x}_{k}" for x in "mg" for k in patterns))


def luhn(number: str) -> str:
    """SQL: whether the digits of ``number`` pass the Luhn test."""
    digit = f"int(substring(reverse({number}), i, 1))"
    return (
        f"aggregate(transform(sequence(1, length({number})), i -> if(i % 2 = 1, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))), 0, (a, b) -> a + b) % 10 = 0"
    )


def mod97(code: str) -> str:
    """SQL: whether the account number ``code`` passes the check on its first four characters."""
    turned = f"concat(substring({code}, 5), substring({code}, 1, 4))"
    digit = "if(c between '0' and '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(filter(split({turned}, ''), c -> c != ''), 0, (a, c) -> {digit}) = 1"


def _valid() -> dict[str, str]:
    part = "int(concat('0', ltrim('0', p)))"
    card = "regexp_replace(x.hit, '[ -]', '')"
    return {
        "email": "true",
        "ip": f"forall(split(x.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 and {part} <= 255)",
        "card": f"length({card}) between 12 and 19 and {luhn(card)}",
        "phone": "length(regexp_replace(x.hit, '[^0-9]', '')) between 9 and 15",
    }


def base_spans(documents: DataFrame) -> DataFrame:
    """``documents`` (text, ...) with ``base``: the valid base matches as (start, kind number, end), sorted."""
    needed = {k: F.col("text").contains(NEEDS[k]) if NEEDS[k] else F.col("text").rlike("[0-9]") for k in KINDS}
    df = _found(documents, BASE, needed)
    valid = _valid()
    parts = (f"transform(filter(s_{k}, x -> {valid[k]}), x -> struct(x.start as start, {n} as kind, x.end as end))" for n, k in enumerate(KINDS))
    return df.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))")).drop(*(f"s_{k}" for k in KINDS))


def _features() -> dict[str, str]:
    """SQL of each feature of a candidate ``x`` (start, end, hit, before, kind, generator), all doubles."""
    digits, letters = "regexp_replace(x.hit, '[^0-9]', '')", "regexp_replace(x.hit, '[^A-Za-z]', '')"
    named = {f"is_{g}": f"if(x.generator = {g}, 1D, 0D)" for g in range(len(GENERATORS))}
    own = " ".join(f"when {n} then x.before rlike r'{CUES[k]}'" for n, k in enumerate(ALL_KINDS))
    dense = "regexp_replace(x.hit, '[^A-Z0-9]', '')"
    iban = " or ".join(f"x.generator = {g}" for g, (k, _) in enumerate(GENERATORS) if k == "iban")
    return named | {
        "n_chars": "double(length(x.hit))",
        "n_digits": f"double(length({digits}))",
        "n_letters": f"double(length({letters}))",
        "n_upper": "double(length(regexp_replace(x.hit, '[^A-Z]', '')))",
        "n_spaces": "double(length(x.hit) - length(replace(x.hit, ' ', '')))",
        "n_colons": "double(length(x.hit) - length(replace(x.hit, ':', '')))",
        "n_slashes": "double(length(x.hit) - length(replace(x.hit, '/', '')))",
        "n_dots": "double(length(x.hit) - length(replace(x.hit, '.', '')))",
        "n_kinds": "double(size(array_distinct(filter(split(x.hit, ''), c -> c rlike '[-_./ ]'))))",
        "n_runs": "double(size(regexp_extract_all(x.hit, '[0-9]+', 0)))",
        "variety": "double(size(array_distinct(split(x.hit, '')))) / length(x.hit)",
        "brackets": "if(x.hit rlike '[(\\\\[{<]', 1D, 0D)",
        "hex": "if(x.hit rlike '^[0-9a-f]+$', 1D, 0D)",
        "leads_zero": f"if(startswith({digits}, '0'), 1D, 0D)",
        "year": f"coalesce(double(try_cast(regexp_extract(x.hit, '(?:19|20)[0-9]{{2}}', 0) as int)), 0D)",
        "luhn": f"if(length({digits}) between 12 and 19 and {luhn(digits)}, 1D, 0D)",
        "iban": f"if(({iban}) and {mod97(dense)}, 1D, 0D)",
        "cue": f"if(case x.kind {own} end, 1D, 0D)",
        "other": f"if(x.before rlike r'{CUES['other']}', 1D, 0D)",
        "assigned": r"if(x.before rlike r'[:=]\s?[\x22\x27]?$', 1D, 0D)",
        "glued": "if(x.before rlike '[A-Za-z0-9_.#/-]$', 1D, 0D)",
    }


def candidates(documents: DataFrame) -> DataFrame:
    """``documents`` (text, ...) with ``found``: every generator's matches with their features."""
    some = F.col("text").rlike(GENERATOR_NEEDS)
    patterns = {f"g{n}": p for n, (_, p) in enumerate(GENERATORS)}
    df = _found(documents, patterns, dict.fromkeys(patterns, some))
    parts = (f"transform(s_g{n}, x -> struct(x.start, x.end, x.hit, x.before, {ALL_KINDS.index(k)} as kind, {n} as generator))" for n, (k, _) in enumerate(GENERATORS))
    df = df.withColumn("proposed", F.expr(f"concat({', '.join(parts)})")).drop(*(f"s_{k}" for k in patterns))
    each = ", ".join(f"{sql} as {name}" for name, sql in _features().items())
    return df.withColumn("found", F.expr(f"transform(proposed, x -> struct(x.start, x.end, x.kind, x.generator, {each}))")).drop("proposed")


def labelled_lines(n: int, seed: int = 5) -> list[tuple[int, str, int, int, str]]:
    """Made-up lines (number, text, start, end, kind) with the place and kind of the personal item in each, kind "" where
    there is none. Items are written in the ways that people write them, whether a generator knows these or not; lines also
    hold figures, dates, codes and names of other sorts, in part with the same looks, so that context has to tell."""
    rng, rows = random.Random(seed), []
    say = lambda *xs: rng.choice(xs)
    some = lambda k, of="0123456789": "".join(rng.choice(of) for _ in range(k))
    word = lambda: some(rng.randint(2, 9), "abcdefghilmnoprstu")
    name = lambda: word().capitalize()
    hexes, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def numbered(size: int) -> str:
        body = say("4", "5", "37", "6011") + some(size)
        body = body[: size - 1]
        return body + next(c for c in "0123456789" if _luhn(body + c))

    def iban() -> str:
        land, own = say("DE", "FR", "ES", "GB", "NL"), some(rng.randint(12, 20))
        turned = "".join(str(int(c, 36)) for c in own + land + "00")
        return f"{land}{98 - int(turned) % 97:02d}{own}"

    def grouped(code: str, size: int, sep: str) -> str:
        return sep.join(code[k : k + size] for k in range(0, len(code), size))

    def day(low: int, high: int) -> str:
        y, m, d = rng.randint(low, high), rng.randint(1, 12), rng.randint(1, 28)
        return say(f"{d}.{m}.{y}", f"{d:02d}/{m:02d}/{y}", f"{y}-{m:02d}-{d:02d}", f"{d:02d}-{m:02d}-{y}", f"{d} {say('May', 'June', 'mars', 'abril')} {y}")

    def token() -> str:
        return say(some(say(32, 40, 64), hexes), some(rng.randint(20, 44), mixed), f"{say('sk', 'ghp', 'xoxb')}{say('_', '-')}{some(30, mixed)}", f"AKIA{some(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", f"{some(22, mixed)}==")

    def street() -> str:
        english = f"{rng.randint(1, 2999)} {name()} {say('Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Blvd')}"
        return say(english, f"{name()}{say('straße', 'weg', 'platz')} {rng.randint(1, 199)}", f"{rng.randint(1, 99)} rue {word()} {word()}", f"Calle {name()} {rng.randint(1, 99)}")

    personal = {
        "email": (lambda: f"{word()}{say('.', '_', '')}{word()}{say('[at]', ' [at] ', '(at)', ' (at) ', ' at ', '{at}', ' AT ')}{word()}{say('.', ' dot ', '[dot]', ' (dot) ', ' [dot] ')}{say('com', 'org', 'net', 'de')}", ("email", "contact", "write to", "mail", "reach me:", "courriel", "ask", "")),
        "ip": (lambda: say(":".join(some(4, hexes) for _ in range(8)), f"2001:db8::{some(3, hexes)}:{some(4, hexes)}", f"fe80::{some(4, hexes)}:{some(4, hexes)}:{some(2, hexes)}"), ("host", "ip", "server", "client", "from", "")),
        "card": (lambda: grouped(numbered(16), 4, say(".", "/", "_", " - ", "  ", ". ")), ("card", "visa", "credit card", "Karte", "paid with", "")),
        "phone": (lambda: say(f"(0{some(2)}) {some(3)}-{some(4)}", f"0{some(3)} {some(3)} {some(4)}", f"{say('2', '3', '7')}{some(2)}-{some(3)}-{some(4)}", f"00{say('44', '49', '33')} {some(3)} {some(4)} {some(2)}", f"0{some(2)}/{some(4)}-{some(3)}", f"{some(3)}.{some(3)}.{some(4)}"), ("tel", "phone", "call", "fax", "mobile", "Telefon:", "Tel.", "ring")),
        "iban": (lambda: say(grouped(iban(), 4, " "), iban()), ("iban", "account", "Konto", "compte", "transfer to", "")),
        "key": (token, ("token", "secret", "api key", "api_key", "access key", "auth token", "bearer", "password", "client_secret")),
        "id": (lambda: say(f"{some(3)}-{some(2)}-{some(4)}", f"{some(1, 'ABCDEFGHKLMN')}{some(8)}", f"{some(8)}{some(1, 'ABCDEFGHKLMN')}", some(11)), ("ssn", "social security", "passport", "national id", "DNI", "Ausweis", "tax number", "insurance")),
        "birth": (lambda: day(1930, 2010), ("born", "born on", "date of birth", "dob", "geboren am", "né le", "nacida el", "birthday")),
        "address": (street, ("lives at", "address", "Anschrift", "home", "moved to", "at", "wohnt in der", "delivered to")),
    }
    ordinary = (
        lambda: f"{say('version', 'release', 'build')} {rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}",
        lambda: f"{say('published', 'updated', 'on', 'meeting of', 'released', 'as of')} {day(1995, 2026)}",
        lambda: f"{say('isbn', 'order', 'part', 'ref', 'serial', 'invoice', '')} {say(f'{some(3)}-{some(3)}-{some(4)}', f'{some(4)}.{some(4)}.{some(3)}', f'{some(3)}-{some(2)}-{some(4)}', grouped(some(16), 4, say('.', '/', '_', ' - ')), some(11))}".lstrip(),
        lambda: f"{say('at', 'score', 'from', '')} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}".lstrip(),
        lambda: f"{say('mac', 'device', '')} {':'.join(some(2, hexes) for _ in range(6))}".lstrip(),
        lambda: f"{say('sha256', 'md5', 'commit', 'digest', 'etag', 'checksum')}{say(' ', ': ', '=')}{some(say(32, 40, 64), hexes)}",
        lambda: f"{say('model', 'part', 'lot', 'sku', 'room', 'flight')} {some(say(1, 2), 'ABCDEFGHKLMN')}{some(rng.randint(6, 9))}",
        lambda: f"{word()} ({say('at', 'dot')}) {word()} . {word()}",
        lambda: f"{word()} at {word()} dot {word()} {word()}",
        lambda: f"{rng.randint(2, 900)} {name()} {say('people', 'tables', 'Works', 'Games')}",
        lambda: f"{say('population', 'sum', 'total')} {some(3)} {some(3)} {some(3)}",
        lambda: f"{word()}-{word()}-{rng.randint(1, 99)}_{word()}{word()}{rng.randint(1, 99)}",
        lambda: f"{some(2, 'ABCDEFGHKLMN')}{some(2)}{some(rng.randint(12, 20))}",
        lambda: f"{say('see', 'section', 'page')} {rng.randint(10, 31)}/{some(3)}/{some(4)}",
    )
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.3:
            text = f"{text} {rng.choice(ordinary)()}".lstrip()
        start = end = 0
        kind = rng.choice(ALL_KINDS) if rng.random() < 0.55 else ""
        if kind:
            item, cue = personal[kind][0](), rng.choice(personal[kind][1])
            cue = cue.upper() if rng.random() < 0.1 else cue
            quote = say('"', "'", "") if kind == "key" else ""
            joint = say(" = ", "=", ": ", " ", " is ") if kind == "key" else say(" ", ": ", " ", " no. ")
            text = f"{text}{say('. ', ' ', ', ')}{cue}{joint if cue else ''}{quote}".lstrip(" ,.")
            start, end = len(text), len(text) + len(item)
            text = f"{text}{item}{quote}"
        if not kind or rng.random() < 0.3:
            text = f"{text} {rng.choice(ordinary)()}".lstrip()
        rows.append((i, f"{text}{say('.', ' ' + word() + '.', ', ' + word() + ' ' + word(), '')}", start, end, kind))
    return rows


def _luhn(number: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(number))) % 10 == 0


_fitted: list[tuple[Boosted, dict[str, float]]] = []


def selector(spark: SparkSession) -> tuple[Boosted, dict[str, float]]:
    """The trees, and a threshold for each kind, fitted once a process on made-up lines: features come from the same
    expressions as in use; every fourth line is set aside for the thresholds. A candidate is true if it holds most of an
    item of its kind and little else."""
    if not _fitted:
        lines = labelled_lines(TRAIN_LINES)
        rows = candidates(spark.createDataFrame(lines, "line long, text string, start long, end long, what string"))
        rows = rows.select("line", "start", "end", "what", F.explode("found").alias("x")).orderBy("line", "x").collect()
        x = np.array([[r.x[name] for name in _features()] for r in rows], float)
        y = np.array([float(is_true(r.x, r)) for r in rows])
        kinds, aside = np.array([r.x.kind for r in rows]), np.array([r.line % 4 == 3 for r in rows])
        model = Boosted(rounds=60).fit(x[~aside], y[~aside])
        least = {}
        for k, name in enumerate(ALL_KINDS):
            own = aside & (kinds == k)
            least[name] = threshold(model.margin(x[own]), y[own], PRECISION) if own.any() else float("inf")
        _fitted.append((model, least))
    return _fitted[0]


def is_true(x, item) -> bool:
    """Whether a candidate is the item (start, end, what) of its line."""
    common = min(item["end"], x["end"]) - max(item["start"], x["start"])
    size = item["end"] - item["start"]
    return ALL_KINDS[x["kind"]] == item["what"] and common >= 0.8 * size and x["end"] - x["start"] <= 1.5 * size


def _kept() -> str:
    """SQL: those of ``scored`` that touch no base span and no better one of them. Neighbours are sought in stretches of the
    text, of which there are about as many as the root of the number of spans: an item is in each that it touches. What
    lambdas use again and again is bound to a name first, as the optimizer would else put it into them."""
    bound = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    cells = lambda items: f"transform(sequence(0, w.last), c -> filter({items}, b -> b.start < (c + 1) * w.width and b.end > c * w.width))"
    width = "int(ceil((length(text) + 1) / ceil(sqrt(1 + size(v.scored) + size(v.base)))))"
    sizes = bound(width, "n", "struct(n as width, int(length(text) div n) as last)")
    apart = "(b.end <= x.start or b.start >= x.end)"
    better = "(b.score > x.score or b.score = x.score and struct(b.start, b.end, b.kind, b.generator) < struct(x.start, x.end, x.kind, x.generator))"
    places = "sequence(int(x.start div w.width), int((x.end - 1) div w.width))"
    free = f"forall({places}, c -> forall(get(z.base, c), b -> {apart}) and forall(get(z.near, c), b -> {apart} or not {better}))"
    near = bound(f"struct({cells('v.base')} as base, {cells('v.scored')} as near)", "z", f"filter(v.scored, x -> {free})")
    return bound("struct(scored, base)", "v", f"if(size(v.scored) = 0, v.scored, {bound(sizes, 'w', near)})")


def personal_data(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) as doc_id, text, base and spans: arrays of (start, kind number, end), sorted.

    Base matches are leftmost and non-overlapping within their kind, and kept if valid: an ip's parts are at most 255,
    a card has 12 to 19 digits that pass Luhn, a phone 9 to 15 digits. Spans are these, and candidates whose boosted
    score reaches the calibrated threshold of their kind, that touch no base span and no better candidate (ties: the
    earlier, then the shorter, then the first kind, then the first generator). Offsets are code points, ends exclusive.

    All is done within the row; nothing is shuffled. A null text counts as empty; a null doc_id stays; repeated rows are
    treated alike; extra columns are ignored; an empty table gives an empty result. The cost is linear in the text; what
    overlaps is sought by stretches of the text, at the power 1.5 of the number of matches in it.
    """
    model, least = selector(documents.sparkSession)
    df = base_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    df = candidates(df)
    score = model.sql([f"x.{name}" for name in _features()])
    df = df.withColumn("scored", F.expr(f"transform(found, x -> struct(x.start, x.end, x.kind, x.generator, {score} as score))"))
    bars = " ".join(f"when {ALL_KINDS.index(k)} then {v!r}D" for k, v in least.items() if np.isfinite(v))
    df = df.withColumn("scored", F.expr(f"filter(scored, x -> coalesce(x.score >= case x.kind {bars} end, false))" if bars else "slice(scored, 1, 0)"))
    df = df.withColumn("kept", F.expr(_kept()))
    added = "transform(kept, x -> struct(x.start as start, x.kind as kind, x.end as end))"
    return df.withColumn("spans", F.expr(f"array_sort(concat(base, {added}))")).select("doc_id", "text", "base", "spans")


def redacted() -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first goes on to the end."""
    names = ", ".join(f"'[{k.upper()}]'" for k in ALL_KINDS)
    step = (
        "(acc, x) -> if(x.start < acc.at, struct(acc.out as out, greatest(acc.at, x.end) as at), "
        f"struct(concat(acc.out, substring(text, acc.at + 1, x.start - acc.at), get(array({names}), x.kind)) as out, x.end as at))"
    )
    return F.expr(f"aggregate(spans, struct('' as out, 0 as at), {step}, acc -> concat(acc.out, substring(text, acc.at + 1)))")


def _written(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in ALL_KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', get(array({names}), x.kind), x.start, x.end)), ',')")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """personal_data in the whole documents table."""
    df = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = (F.expr(f"size(filter(base, x -> x.kind = {n}))").cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS))
    found = F.size("spans").cast("long").alias("n_spans")
    return df.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"), found)
