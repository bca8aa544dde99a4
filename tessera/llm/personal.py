"""Personal data in texts: fixed patterns, and spans that a conditional random field over word shapes adds to them."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.crf import TOKEN, Crf, Decoder, fit, spans_of
from tessera.llm.words import grouped_texts

#: Kinds in the order in which spans are listed; the patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "name", "address")
BASE_KINDS = KINDS[:4]
FOUND = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"

# The patterns of the base.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What stands for the signs of an address of mail where it is spelled out.
AT = {"@", "at", "arroba", "arobase"}
DOT = {"dot", "punkt", "punto", "point"}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern finds leftmost: the name before each @ as far as its characters go, back to the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text[begin - 1]):
            begin -= 1
        found = HOST.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the patterns' matches that hold, by kind and begin."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        # A part of more than three digits may be zeros before a small number.
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# --- the labelled table

# Labelled lines, <kind text> around each span; braces are filled in. Lines without a span show what is none.
LINES = """
write to <email {user} at {host} dot {tld}> today
or <email {user} [at] {host} [dot] {tld}> {word}
{word} <email {user} (at) {host} (dot) {tld}>
mail <email {user}.{user} at {host} dot {tld}>, {word}
E-Mail: <email {user} at {host} punkt {tld}>
{word} <email {user} arroba {host} punto {tld}> {word}
courriel : <email {user} arobase {host} point {tld}>
{word} <email {user}.{d2}@{host}{d1}.example.{tld}> {word}
<email {user}@{host}.{tld}>
call <phone ({d3}) {d3}-{d4}> {word}
phone: <phone {d3}-{d3}-{d4}>
call me on <phone {d3}.{d3}.{d4}> {word}
Tel. <phone 0{d3}/{d6}>
Tel: <phone 0{d3} {d6}>, {word}
Telefon <phone 0{d2}-{d6}> {word}
téléphone <phone 0{d1} {d2} {d2} {d2} {d2}> {word}
tél. <phone 0{d1}.{d2}.{d2}.{d2}.{d2}>
teléfono <phone 9{d2} {d3} {d3}> {word}
fax <phone ({d3}) {d3}-{d4}>
{word} <phone +{d1} ({d3}) {d3}-{d4}> {word}
<phone +{d2} {d3} {d6}> {word}
{word} Mr. <name {Name} {Name}> {word}
{word} Mr <name {Name}> {word}
{word} Mrs. <name {Name} {Name}>, {word}
Ms. <name {Name} {Name}> {word}
Dr. <name {Name} {Name}> {word}
my name is <name {Name} {Name}>.
signed, <name {Name} {Name}>
Name: <name {Name} {Name}>
{word} Herr <name {Name} {Name}> {word}
{word} Frau <name {Name}> {word}
mein Name ist <name {Name} {Name}>, {word}
{word} Monsieur <name {Name}> {word}
{word} Madame <name {Name} {Name}>, {word}
je m'appelle <name {Name} {Name}>.
{word} Señor <name {Name}> {word}
{word} Señora <name {Name} {Name}>.
me llamo <name {Name} {Name}> {word}
lives at <address {n} {Name} Street> {word}
{word} <address {n} {Name} Road>, {word}
{word} <address {n} {Name} Avenue>.
{word} <address {Name} Straße {n}> {word}
wohnt in der <address {Name}straße {n}>, {word}
{word} <address {n} rue de {Name}> {word}
habite au <address {n}, avenue {Name}>
{word} <address calle {Name} {n}>, {word}
vive en la <address calle de {Name}, {n}>
{word} at the {word} dot {word}
he was at home, {word}
at {n} o'clock, {word}
{word} [at] {word}
{word} point {word} de {word}
{Word}. {Word} {word} {word}
{word}, {Word} {word}
{word}! {Word} {Word} {word}
{Word} {word} name {word} is {word}
{d4}-{d2}-{d2} {word}
{d2}:{d2} {word}
pages {d2}-{d2}, {word}
{word} ({d4}) {word}
{word} ({d3}) {word}
{word} {d16} {word}
{d16} {d16} {word}
card {d4} {d4} {d4} {d4} {word}
{word} {d2}.{d3}.{d2}.{d3} {word}
token = "{hex}" {word}
api_key: {hex} {word}
{word} {d1}.{d2} {word}
{word} | {d3} | {word} | {word}
{word} {d5} {word} {d3} {word}
Version {d1}.{d1}, {Word} License {word}
{word}### {word}%%% {word}&&& {Word}***
{Word} {Word} {Word} {Word} {Word}
rue {word}, {word} street {word}
Road {word} {n} {word}
{word} street {n} {word}
{word} straße {word}
call {word} {word}, phone {word}
Herr {word}, frau {word}
Mr. {word} {word}
{again}
{again}
{again}
{word}. {Word} {Word} {word}
{word}. {Word} {Word}. {word}
{prose}
{prose}
{prose}
{prose}
{prose}
{prose}
"""

# Parts of the words that fill the lines.
PARTS = "an ber ca de el er ges ha ing ja ko la mar nen or pe que ri schu son ta ti ung vel wo és ñar ön über ch le".split()


def word_of(rng: random.Random) -> str:
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4)))


def prose_of(rng: random.Random) -> str:
    """A few sentences with words of any length, commas and line ends."""
    out = []
    for _ in range(rng.randint(2, 5)):
        words = [word_of(rng) + rng.choice(("", "", "", "", ",")) for _ in range(rng.randint(1, 9))]
        out.append(" ".join(words).capitalize() + rng.choice((". ", ". ", ".\n", "! ", " ")))
    return "".join(out)


def filled(line: str, rng: random.Random) -> str:
    def value(slot: re.Match) -> str:
        name = slot[1]
        if re.fullmatch(r"d\d+", name):
            return "".join(rng.choice("0123456789") for _ in range(int(name[1:])))
        made = {
            "word": lambda: " ".join(word_of(rng) for _ in range(rng.randint(1, 4))),
            "Word": lambda: word_of(rng).capitalize(),
            "Name": lambda: (word_of(rng) + rng.choice(("a", "er", "sen", "ez"))).capitalize(),
            "again": lambda: " ".join([word_of(rng).capitalize()] * rng.randint(2, 9) + [word_of(rng)] * rng.randint(2, 9)),
            "prose": lambda: prose_of(rng),
            "n": lambda: str(rng.randint(1, 300)),
            "user": lambda: word_of(rng),
            "host": lambda: rng.choice(("mail", "post", word_of(rng))),
            "tld": lambda: rng.choice(("com", "org", "net", "de", "fr", "es")),
            "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)),
        }
        return made[name]()

    return re.sub(r"\{(\w+)\}", value, line)


def labelled_rows(times: int = 8, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with (begin, end, kind) spans: each of LINES so many times with words and numbers of its own."""
    rng, rows = random.Random(seed), []
    for line in LINES.strip().split("\n"):
        for _ in range(times):
            marked = filled(" ".join([word_of(rng)] * rng.randint(0, 1) + [line] + [word_of(rng)] * rng.randint(0, 1)), rng)
            text, spans, done = "", [], 0
            for m in re.finditer(r"<(\w+) ([^>]*)>", marked):
                text += marked[done : m.start()]
                spans.append((len(text), len(text) + len(m[2]), m[1]))
                text, done = text + m[2], m.end()
            rows.append((text + marked[done:], spans))
    return rows


def labelled_table(spark: SparkSession, times: int = 8, seed: int = 5) -> DataFrame:
    """The labelled lines as a table: text, spans (start, end, kind)."""
    return spark.createDataFrame(labelled_rows(times, seed), "text string, spans array<struct<start: int, end: int, kind: string>>")


# --- over documents


def plausible(kind: str, text: str) -> bool:
    """What a span of the field has to have besides."""
    if kind == "phone":
        return 7 <= len(digits_of(text)) <= 15
    words = re.findall(r"\w+|@", text.lower())
    if kind == "email":
        return len(words) <= 12 and not AT.isdisjoint(words) and (not DOT.isdisjoint(words) or "." in text)
    if kind == "name":
        return text[0].isupper() and len(set(words)) == len(words) <= 4
    return len(words) <= 8 and any(c.isdigit() for c in text)


def all_spans(text: str, added: list[tuple[int, int, str]]) -> list[tuple[str, int, int, bool]]:
    """The patterns' spans, and of those added the plausible ones that meet none of them; by kind, then begin."""
    base = base_spans(text)
    out = [(k, a, b, True) for k, a, b in base]
    out += [(k, a, b, False) for a, b, k in added if plausible(k, text[a:b]) and not any(a < y and x < b for _, x, y in base)]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_spans(crf: Crf, masked: bool):
    """For mapInArrow: (doc_id, text) to FOUND, with the masked text where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(crf)
        for keys, texts in grouped_texts(batches, 4_000_000):
            texts = texts.to_pylist()
            tokens = [TOKEN.findall(t) for t in texts]
            spans = []
            for text, own, (places, labels) in zip(texts, tokens, decoder.decode(tokens), strict=True):
                spans.append(all_spans(text, spans_of(crf.labels, own, places, labels)))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            rows = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in s] for s in spans]
            columns = {"doc_id": pa.array(keys, pa.int64()), "spans": pa.array(rows, kind)}
            if masked:
                columns["masked"] = pa.array([mask(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with the name of the first kind that covers it in place of each stretch of covered characters."""
    out, done = [], 0
    for a, b, k in sorted((a, -b, KINDS.index(k)) for k, a, b, _ in spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k]}]"]
        done = max(done, -b)
    return "".join([*out, text[done:]])


def personal_data(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    masked: bool = False,
    max_labelled: int = 5_000,
) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each row; with `masked`, also its text with spans replaced by kinds.

    Spans count characters, ends excluded, and come by kind (in the order of KINDS), then start. The base spans are those of
    fixed patterns for addresses of mail and hosts, card numbers that pass Luhn's test and international phone numbers. A
    linear-chain conditional random field adds spellings that no pattern has (name at host dot org, national phone
    numbers), names behind titles and street addresses, where they meet no base span. It is fitted here on `labelled` (text,
    spans with start, end and kind; default: labelled_table), of which the first max_labelled rows in order of their text
    are read, and goes to each task; whole texts are decoded by Viterbi's algorithm in numpy batches. Nothing is shuffled.

    Null and empty texts: no spans (masked: an empty text). Very long texts: decoded whole. Null or repeated ids and
    repeated rows: each row has its own result. Empty table: empty result; an empty labelled table adds nothing. Only id_col
    and text_col are read, so other columns do not matter.
    """
    if labelled is None:
        rows = labelled_rows()
    else:
        found = labelled.where(F.col("text").isNotNull()).select("text", "spans").orderBy("text").limit(max_labelled).collect()
        rows = [(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["spans"] or []]) for r in found]
    crf = fit(rows, ["email", "phone", "name", "address"])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(find_spans(crf, masked), FOUND + ", masked string" * masked)
