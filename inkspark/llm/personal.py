"""Personal information in free text (problem 2), by weak supervision.

Broad patterns propose spans. Labelers look at a span's shape, at word lists and at the words around
it, and vote for it, against it or not at all. What labelers know of names is learned from the corpus:
words that stand beside many different listed names are cues, and given and family names are those that
stand beside cues and with several different partners. Votes are counted by pattern over all records; on
these counts, expectation-maximisation estimates how far each labeler can be trusted, and a logistic
regression on the resulting probabilities is the span classifier. The texts are read a second time for
names in lower case or in capitals that hold a known name. Accepted spans of a record that overlap
compete, and what is left goes to the list of items and becomes placeholders.

Evidence is counted over distinct surroundings, and what is learned hangs on bounds of shares and on
how evenly partners are spread, so that copies of the records change nothing.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.session import materialize

#: Names with this share of the spans are looked up where the spans are.
HOT = 50_000
#: Bits, as a power of two, of the table that tells which words may be learned names (1 MB; exact joins follow).
FILTER_BITS = 23
TYPES = ("email", "phone", "id_number", "address", "name")

# The words that labelers look for, by what they speak for.
UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶĹĽŁŃŅŇŌŐŘŚŞŠŢŤŪŮŰŲŹŻŽ"
SENTENCE_START = re.compile(r"(?:^|[.!?。！？:][\"')\]]* +|\n[ ]*(?:[>*-] |\d+\. |- \[.\] |#+ )?)$")
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|M|Mme|Mlle|Madame|Monsieur|Sr|Sra|Srta|Señor|Señora|Dra|Don|Doña)"
TITLE_WORDS = set("mr mrs ms miss dr prof herr frau mme mlle madame monsieur sr sra srta señor señora dra don doña".split())
PHONE_CUE = re.compile(
    r"(?i)(?:\b(?:call|ring|phone|mobile|number is|line|fax|reach|dial|telefon|anrufen|rückruf|handy|appeler|téléphone|llamar|teléfono|móvil|text)\b|\btel\b|\btél\b|电话|手机)"
)
EMAIL_CUE = re.compile(r"(?i)(?:mailto:|<|mail|send|from:|\bcc |contact|kontakt|reachable|erreichbar|joignable|escribe|écris|correo|login|联系|\|)[^\n]{0,24}$")
PHONE_NEXT = re.compile(r"(?i)(?:@|[\])] |\bat\b|\bdot\b)[^\n]{0,30}[,/|] ?(?:tel:)?$")
PHONE_AFTER = re.compile(r"(?i)^[ ,)]*(?:ext\b|anrufen|, ?office)")
OTHER_NUMBER = re.compile(r"(?i)(?:hash|order|isbn|coordinates|\bref|build|serial|\bsn\b|commit|version|ticket|invoice|addr|issue|sku|batch|\bpr\b|#)[^\n]{0,22}$")
ID_CUE = re.compile(
    r"(?i)(?:\bssn\b|\bsocial\b|social security|insurance|tax id|\btin\b|\bni number|\bnino\b|passport|reisepass|\bpass-?nr|ausweis|idnr|steuer-?(?:id|nr|nummer)|sozialversicherung|\bsvnr"
    r"|\bnie\b|\bdni\b|\bnif\b|pasaporte|seguridad social|s[ée]cu|passeport|carte d.identité|\bcni\b|national id|identity|\bid(?: no| number|-nr)|身份证|护照|社保|税号)[^\w\n]{0,3}(?:no|nr|n°|number|num|号|号码|是|为|ist|est|es)?[^\w\n]{0,4}$"
)
#: What follows a name in lists of contacts: a number, an address or a mail address.
CONTACT_AFTER = re.compile(
    r"(?:\]\])?(?: ?\| ?(?:tel:)?[+(]?\d[\d ().-]{6,}| ?\| ?<|[ ]?<?[\w.+-]+ ?(?:@|[\[(] ?at ?[\])]| AT )|(?: ?\||,|[ ]*\r?\n) ?(?i:flat |apt )?\d+\w?,? (?:\S+ ){1,3}?(?i:street|st|road|rd|lane|ave|avenue|drive|close|way|terrace|court|crescent|place)\b"
    r"|(?: ?\||,|[ ]*\r?\n) ?(?:\d+\w?,? (?i:rue|avenue|allée) |\w+(?i:straße|str\.|weg|gasse|platz|allee) \d|(?i:calle|avenida|c/) ))"
)
#: Salutations, signatures and the like; other cue words are learned.
NAME_BEFORE = re.compile(
    r"(?i)\b(?:dear|hi|hello|hallo|liebe|lieber|estimad[oa]|querid[oa]|regards|sincerely|thanks|signed|grüße|gruß|cordialement|saludos|from:|attn|contact|i'm|i am|name is|ich bin|je suis|soy|written by|reviewed by|spoke with|met)[,:]?[ ]+$"
)
HEADING = re.compile(r"(?:^|\n)#{1,6}[ ]$|\|---$")
NOT_NAME_WORDS = set(
    "the a an of in on at by to for with from is are was and or but not no that this it its we they who what which when why how where if so as both half once since before another here let see start"
    " der die das den dem ein eine einen und oder ohne mit bei zu von für auf wer was wie warum le la les un une des du de et ou sans avec pour qui que pourquoi el los las un unos y o sin con para quién qué"
    " monday tuesday wednesday thursday friday saturday sunday january february march july september october november december street st road rd lane drive close way terrace crescent court square avenue ave flat calle avenida rue".split()
)
STREET_WORDS = (" Street", " St", " Road", " Rd", " Lane", " Ln", " Avenue", " Ave", " Drive", " Close", " Way", " Terrace", " Court", " Cres", " Gardens", " Row", " Square", " Sq", " Place", " Hill", " Walk", " Mews", " Grove")
STREETS = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Close|Way|Terrace|Court|Crescent|Cres|Gardens|Row|Square|Sq|Place|Hill|Walk|Mews|Grove)"

_AT = r"(?:@| @ | ?[\[({] ?at ?[\])}] ?| AT )"
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?| DOT )"
EMAIL = re.compile(rf"(?<![\w.%+-])[\w.%+-]++(?:{_AT}[\w-]++(?:{_DOT}[\w-]++)+| at [\w-]++(?: dot [\w-]++)+)")
#: Stretches with enough digits for a number; only these are looked at for phone and identity numbers.
ZONE = re.compile(r"\d[\d ()./A-Z-]{5,}")
PHONE = re.compile(
    r"(?<![\w.+#/-])(?:\+44 ?(?:\(0\) ?)?(?:\d{2} ?\d{4} ?\d{4}|\d{4} ?\d{3} ?\d{3})|\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+49 ?(?:\(0\) ?)?\d{2,4}[ /-]?\d{4,8}(?:-\d{1,4})?"
    r"|\+33 ?(?:\(0\) ?)?\d(?:[ .]?\d\d){4}|\+34 ?\d{3}(?: ?\d{3}){2}|\+\d{1,3}(?:[ -]?\d{2,4}){2,5}|07\d{3} ?\d{3} ?\d{3}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}"
    r"|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}|1[2-9]\d{9}|0\d{2,4}[/ -]\d{3,5}[ -]\d{3,5}|0\d{2,4}[/ -]\d{5,8}|0\d([ .-]?)\d\d(?:\2\d\d){3}|[6789]\d{2} ?\d{3} ?\d{3}|[6789]\d{2}(?: \d\d){3})(?![\w/-]|\.\d)"
)
ID = re.compile(
    r"(?<![\w.+#/-])(?:\d{3}[ -]\d{2}[ -]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{2} ?\d{4,5}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d \d{2} \d{2} \d[\dAB] \d{3} \d{3}(?: \d{2})?"
    r"|\d{13,15}|\d{9}|\d{6}-?\d{4}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}\d?|\d{17}[\dX])(?![\w/-]|\.\d)"
)
ADDRESSES = (
    (STREET_WORDS, re.compile(rf"(?<![\w.,/-])\d{{1,4}}[a-z]?,? (?:[{UP}][\w'’-]+ ){{1,3}}?{STREETS}\b")),
    (("straße", "strasse", "str.", "gasse", "weg ", "allee ", "platz ", "ring ", "ufer ", "damm "), re.compile(rf"\b[{UP}][\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer|damm) \d{{1,4}}[a-z]?\b")),
    (
        (" rue ", " avenue ", " allée ", " chemin ", " boulevard ", " place ", " impasse ", " quai ", " cours ", " route "),
        re.compile(rf"(?<![\w./-])\d{{1,4}}[a-z]?(?: bis)?,? (?:rue|avenue|allée|chemin|boulevard|place|impasse|quai|cours|route)(?: (?:de la|des|du|de|de l['’]|d['’]))? ?[{UP}][\w'’-]+(?: [{UP}][\w'’-]+)*"),
    ),
    (
        ("Calle", "Avenida", "Avda", "Paseo", "Plaza", "Camino", "Ronda", "C/"),
        re.compile(rf"(?:\b(?:Calle|Avenida|Avda\.?|Paseo|Plaza|Camino|Ronda)|(?<!\w)C/)(?: (?:de la|de los|de las|del|de))? [{UP}][\w'’-]+(?: [{UP}][\w'’-]+)*,? \d{{1,4}}[a-z]?\b"),
    ),
    (("号",), re.compile(r"[一-鿿]{2,8}[路街道巷]\d{1,4}号")),
)
ADDRESS_CUE = re.compile(
    r"(?i)(?:live at|moved to|deliver|goes to|letter to|address|adresse|wohnt|paket|termin|habite|colis|dirección|vive|paquete|寄到|flat \d+, |\||,|^|\n)[^\n]{0,30}$"
)
NAME = re.compile(
    rf"(?<![\w@'’-])(?=("
    rf"[{UP}]\w+, [{UP}][^\W\d_{UP}]+"  # FAMILY, Given; the case of the first is checked later
    rf"|(?:[{UP}][^\W\d_{UP}]+|[{UP}]\.)(?: [{UP}]\.)* +[{UP}][^\W\d_]*[^\W\d_{UP}]+(?:-[{UP}][^\W\d_]+)?"
    rf"|[{UP}]{{3,}}(?:-[{UP}]{{3,}})?, [{UP}][^\W\d_{UP}]+"
    rf"|[{UP}]{{2,}} [{UP}]{{3,}}(?:-[{UP}]{{3,}})?"
    rf"))(?=[{UP}])"
)
#: Two words (or an initial and a word) all in lower case or all in capitals.
ONE_CASE = re.compile(
    rf"(?<![\w@'’-])(?=((?:[^\W\d_{UP}]{{3,}}|[^\W\d_{UP}]\.)(?: [^\W\d_{UP}]\.)? [^\W\d_{UP}]{{4,}}(?:-[^\W\d_{UP}]{{3,}})?"
    rf"|(?:[{UP}]{{2,}}|[{UP}]\.)(?: [{UP}]\.)? [{UP}]{{3,}}(?:-[{UP}]{{3,}})?)(?![\w-]))"
)
ONE_CASE_WORD = re.compile(rf"[^\W\d_{UP}]{{3,}}|[{UP}]{{2,}}")
BEFORE_TITLE = re.compile(rf"(?<!\w)(?i:{TITLES})\.? +$")
PLAIN = re.compile(r"[\W_]+")
TOKEN = re.compile(r"\w+|[^\w\s]|\n")
DIGIT = re.compile(r"\d")


def _vote(yes: object, no: object = False) -> int:
    return 2 if yes else 0 if no else 1


def spans(text: str, listed: set[str]) -> Iterator[tuple]:
    """Type, start, end, votes (0 against, 1 none, 2 for), and for names given, family and what is beside them, of all proposed spans; listed: given names in lower case."""
    if "@" in text or "at]" in text or "at)" in text or " AT " in text or " dot " in text:
        for m in EMAIL.finditer(text):
            top = re.split(r"[^\w]+", m[0].rstrip())[-1]
            a, b = m.span()
            votes = _vote(top.isalpha() and len(top) > 1, any(c.isdigit() for c in top)), _vote("@" in m[0] and " " not in m[0]), _vote(EMAIL_CUE.search(text[max(0, a - 40) : a])), _vote("@" not in m[0])
            yield 0, a, b, votes, "", "", "", "", 0, False
    for zone in ZONE.finditer(text):
        lo, hi = max(0, zone.start() - 5), min(len(text), zone.end() + 3)
        for m in PHONE.finditer(text, lo, hi):
            a, b = m.span()
            left, right = text[max(0, a - 36) : a].rpartition("\n")[2], text[b : b + 24]
            n = sum(c.isdigit() for c in m[0])
            cue = PHONE_CUE.search(left[-26:]) or PHONE_AFTER.match(right) or left.endswith(("tel:", "/ ", "| ")) or PHONE_NEXT.search(left)
            yield 1, a, b, (_vote(n in (10, 11, 12, 13)), _vote(cue, not cue), _vote(False, OTHER_NUMBER.search(left) or ID_CUE.search(left)), _vote(m[0][0] == "+", n < 10)), "", "", "", "", 0, False
        for m in ID.finditer(text, lo, hi):
            a, b = m.span()
            left = text[max(0, a - 34) : a].rpartition("\n")[2]
            cue = ID_CUE.search(left)
            yield 2, a, b, (_vote(cue, not cue), _vote(False, OTHER_NUMBER.search(left) and not cue), _vote(any(c.isalpha() for c in m[0])), _vote(False, PHONE_CUE.search(left))), "", "", "", "", 0, False
    for marks, pattern in ADDRESSES:
        if any(x in text for x in marks):
            for m in pattern.finditer(text):
                a, b = m.span()
                follows = re.match(r"(?:,? (?:\d{5}|[A-Z]{1,2}\d)|, [A-ZÀ-Þ]|[.;,|\n\r。 ]|$)", text[b : b + 10])
                votes = _vote(ADDRESS_CUE.search(text[max(0, a - 40) : a])), _vote(follows, True), _vote(not re.match(r" (?:route|failures|stops)\b", text[b : b + 10]), True), _vote(True)
                yield 3, a, b, votes, "", "", "", "", 0, False
    for m in NAME.finditer(text):
        yield from _name(text, *m.span(1), m[1], listed)


def one_case_spans(text: str, given_known: Callable[[str], bool], family_known: Callable[[str], bool]) -> Iterator[tuple]:
    """As spans, for pairs of words in lower case or in capitals of which one is a known name."""
    if not any(given_known(w) or family_known(w) for w in {w.lower() for w in ONE_CASE_WORD.findall(text)}):
        return
    for m in ONE_CASE.finditer(text):
        words = m[1].lower().split(" ")
        if given_known(words[0].rstrip(".")) or family_known(words[-1].split("-")[0]):
            yield from _name(text, *m.span(1), m[1], None)


def _beside(text: str, a: int, b: int) -> tuple[str, str, int]:
    """The two tokens before and behind a span, in lower case, numbers as 0 and ends of sentences before a word as dots, and a checksum of what surrounds it."""
    left, right = TOKEN.findall(text[max(0, a - 32) : a].lower())[-2:], TOKEN.findall(text[b : b + 32].lower())[:2]
    key = lambda tokens: " ".join("0" if DIGIT.search(t) else t for t in tokens)
    if len(left) == 2 and left[0] in "\n.!?。！？" and left[1].isalpha():
        left[0] = "."
    return key(left), key(right), zlib.crc32(text[max(0, a - 40) : b + 40].encode())


def _name(text: str, a: int, b: int, span: str, listed: set[str] | None) -> Iterator[tuple]:
    """The span of a name; listed is None in the second look, which reads what is in one case."""
    if "," in span:
        family, given = parts = re.split(r", +", span, maxsplit=1)
        if family.upper() != family or len(family) < 3:
            return
    else:
        parts = span.split()
        given, family = parts[0], parts[-1]
    given, upper, family = given.lower().rstrip("."), span.isupper(), family.lower()
    if given in TITLE_WORDS or family in TITLE_WORDS or (listed is not None and upper):
        return
    if family in NOT_NAME_WORDS or (listed is not None and len(given) > 1 and given in NOT_NAME_WORDS and given not in listed):
        return
    left, right = text[max(0, a - 24) : a], text[b : b + 40]
    title = BEFORE_TITLE.search(left)
    start = a - len(title[0]) if title else a
    left = left[: len(left) - (a - start)]
    yield 4, a, b, (
        _vote(NAME_BEFORE.search(left), HEADING.search(left)),
        _vote(CONTACT_AFTER.match(right)),
        _vote(title),
        _vote(False, SENTENCE_START.search(left)),
        _vote("," in span or len(given) == 1),
        _vote(False, span.islower()),
    ), given, family.split("-")[0], *_beside(text, start, b), "." in span[1:] and "," not in span and not parts[0].endswith(".")


SPAN = "kind int, start int, end int, item string, votes string, given string, family string, left string, right string, near long, middle boolean"
KEY = ("rec_type", "rec_id", "text_hash")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_type, rec_id, text_hash, content of notes and turns with content."""
    parts = [("note", "notes", "note_id"), ("turn", "turns", "turn_id")]
    rows = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(kind).alias("rec_type"), F.col(key).cast("long").alias("rec_id"), F.xxhash64("content").alias("text_hash"), "content") for kind, t, key in parts]
    return reduce(DataFrame.unionByName, rows).where("rec_id is not null and content is not null")


def listed_names(given_names: DataFrame) -> set[str]:
    """The given names of the list, in lower case."""
    return {r.g for r in given_names.select(F.lower("given_name").alias("g")).where("g is not null").distinct().collect()}


def propose(rows: DataFrame, find: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """The spans that find gives for each text (columns of KEY and SPAN); repeated rows give each once."""
    names = [*KEY, *(x.split(" ")[0] for x in SPAN.split(", "))]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 6, pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for *key, text in zip(*(c.to_pylist() for c in b.columns)):
                for kind, x, y, votes, *name in find(text):
                    out.append((*key, kind, x, y, PLAIN.sub("", text[x:y].lower()), "".join(map(str, votes)), *name))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.select(*KEY, "content").mapInArrow(run, f"rec_type string, rec_id long, text_hash long, {SPAN}").distinct()


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability of being right for each vote pattern (rows; 0 against, 1 none, 2 for), weighted by counts.

    A vote is at first taken to be right nineteen times in twenty, which weighs as much as all spans.
    """
    total = counts.sum()
    prior = total + 1
    share = np.stack([(counts[:, None] * (votes == v)).sum(0) / total for v in range(3)])
    trust = {1: np.array([0.05, 0.5, 0.95]), 0: np.array([0.95, 0.5, 0.05])}
    base = {y: (w := trust[y][:, None] * (share + 0.02)) / w.sum(0) for y in trust}
    p, theta = 0.2, {y: b.copy() for y, b in base.items()}
    q = np.zeros(len(votes))
    for _ in range(rounds):
        log = {y: sum(np.log(theta[y][votes[:, j], j]) for j in range(votes.shape[1])) + np.log(p if y else 1 - p) for y in theta}
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        for y, w in ((1, q * counts), (0, (1 - q) * counts)):
            seen = np.stack([(w[:, None] * (votes == v)).sum(0) for v in range(3)])
            theta[y] = (seen + prior * base[y]) / (w.sum() + prior)
        p = float(np.clip((q * counts).sum() / total, 0.01, 0.99))
    return q


def logistic(votes: np.ndarray, q: np.ndarray, counts: np.ndarray, rounds: int = 50, penalty: float = 1e-4) -> np.ndarray:
    """Weights (labelers x values, then the constant) of a logistic regression on soft labels, by Newton's steps; counts weigh by their share."""
    counts = counts / counts.sum()
    x = np.hstack([(votes[:, :, None] == np.arange(3)).reshape(len(votes), -1).astype(float), np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (q - p)) - penalty * w
        hess = (x.T * (counts * p * (1 - p))) @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step / max(1, np.abs(step).max() / 2)
    return w


def _classify(patterns: list[tuple[int, str, int]]) -> list[tuple[int, str, float]]:
    """Type, votes and probability of every vote pattern."""
    out = []
    for kind in range(len(TYPES)):
        mine = [(v, n) for k, v, n in patterns if k == kind]
        if mine:
            votes, counts = np.array([[int(c) for c in v] for v, _ in mine]), np.array([n for _, n in mine], float)
            w = logistic(votes, expectation_maximisation(votes, counts), counts)
            p = 1 / (1 + np.exp(-(w[-1] + sum(w[3 * j + votes[:, j]] for j in range(votes.shape[1])))))
            out += [(kind, v, float(x)) for (v, _), x in zip(mine, p)]
    return out


def _patterns(proposed: DataFrame) -> list[tuple[int, str, int]]:
    return [(r.kind, r.votes, r.n) for r in proposed.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()]


def _first_look(spark: SparkSession, listed: set[str]) -> Callable[[str], Iterator[tuple]]:
    shared = spark.sparkContext.broadcast(listed)
    return lambda text: spans(text, shared.value)


def filter_of(names: DataFrame) -> np.ndarray:
    """A bit for the checksum of each name in the only column, cut to FILTER_BITS: of fixed size, however many there are."""
    at = F.crc32(names.columns[0]) % (1 << FILTER_BITS)
    words = names.select(F.floor(at / 32).alias("word"), (at % 32).cast("int").alias("bit"))
    out = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    for r in words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect():
        out[r.word] = r.bits
    return out


def _second_look(spark: SparkSession, given: np.ndarray, family: np.ndarray) -> Callable[[str], Iterator[tuple]]:
    shared = spark.sparkContext.broadcast((given, family))

    def known(word: str, bits: np.ndarray) -> bool:
        at = zlib.crc32(word.encode()) % (1 << FILTER_BITS)
        return bool(int(bits[at >> 5]) >> (at & 31) & 1)

    def find(text: str) -> Iterator[tuple]:
        given, family = shared.value
        return one_case_spans(text, lambda w: known(w, given), lambda w: known(w, family))

    return find


def bound(good: Column, n: Column, side: int) -> Column:
    """The lower (side -1) or upper (1) bound of Wilson's interval of the share good of n, at 95 percent on that side."""
    z = 1.645
    return (good + z * z / 2 + side * z * F.sqrt(good * (n - good) / n + z * z / 4)) / (n + z * z)


def spread(rows: DataFrame, by: str, partner: str, **counted: Column) -> DataFrame:
    """Per by: n, the sum of each of counted (0 or 1), and its spread: over how many partners it is, were they equally frequent."""
    parts = rows.where(F.length(by) > 0).groupBy(by, partner).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in counted.items()])
    squares = [F.try_divide(F.sum(k).cast("double") ** 2, F.sum(F.col(k).cast("double") ** 2)).alias(f"{k}_spread") for k in counted]
    return parts.groupBy(by).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in counted], *squares)


def learn_cues(evidence: DataFrame, side: str) -> DataFrame:
    """side, vote: 2 for words beside many different listed names, 0 for those that hardly ever are beside one.

    A cue has, by the lower bound, a listed name in at least a quarter of its spans, spread as over at
    least five names; fixed phrases that begin like names repeat a few.
    """
    by = spread(evidence, side, "given", listed=F.col("listed").cast("long"))
    cue = (bound(F.col("listed"), F.col("n"), -1) >= 0.25) & (F.col("listed_spread") >= 5)
    return by.select(side, F.when(cue, "2").when(bound(F.col("listed"), F.col("n"), 1) < 0.1, "0").alias("vote")).where("vote is not null")


def learn_names(evidence: DataFrame, column: str, partner: str, good: Column) -> DataFrame:
    """column, vote, good: 2 for names that are good in at least a third of their spans (lower bound) with a spread of two partners, 0 for words hardly ever beside a cue."""
    by = spread(evidence.where(F.length(column) > 2), column, partner, good=good.cast("long"), cued=F.col("cued").cast("long"))
    vote = F.when(bound(F.col("cued"), F.col("n"), 1) < 0.25, "0").when((bound(F.col("good"), F.col("n"), -1) * 3 >= 1) & (F.col("good_spread") >= 2), "2")
    return by.select(column, vote.alias("vote"), "good").where("vote is not null")


def rather_names(learned: DataFrame, again: DataFrame, column: str) -> DataFrame:
    """The names (column, good) that aren't ordinary words: those with no more distinct spans in one case than good ones."""
    seen = again.select("given", "family", "near").distinct().groupBy(column).agg(F.count("*").alias("n"))
    return learned.join(seen, column, "left").where(F.coalesce("n", F.lit(0)) <= F.col("good")).select(column, F.lit("2").alias("vote"))


def voted(found: DataFrame, tables: dict[str, DataFrame], salt: str = "near") -> DataFrame:
    """found with column_vote for the columns of tables: the vote that tables[column] (column, vote) has for it, else null.

    Values with one in HOT of a column's spans, which are at most HOT, are looked up in a broadcast table.
    Others are matched by a shuffle, for which all other rows get keys of their own.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in tables])).alias("x")
    counts = materialize(found.select(each).select("x.*").where(F.length("value") > 0).groupBy("column", "value").agg(F.count("*").alias("n")), "counts")
    totals = {r.column: (r.total, r.least) for r in counts.groupBy("column").agg(F.sum("n").alias("total"), F.min("n").alias("least")).collect()}
    for c, known in tables.items():
        total, least = totals.get(c, (0, 0))
        vote, known = f"{c}_vote", known.select(c, F.col("vote").alias(f"{c}_vote"))
        hot = counts.where((F.col("column") == c) & (F.col("n") * HOT >= total)).select(F.col("value").alias(c))
        found = found.join(F.broadcast(hot.join(known, c, "left").withColumn("hot", F.lit(True))), c, "left")
        if least * HOT < total:
            key = F.when(F.col("hot").isNull() & (F.length(c) > 0), F.col(c)).otherwise(F.concat(F.lit("\0"), F.col(salt)))
            rest = known.select(F.col(c).alias("key"), F.col(vote).alias("rest"))
            found = found.withColumn("key", key).join(rest, "key", "left").withColumn(vote, F.coalesce(vote, "rest")).drop("key", "rest")
        found = found.drop("hot")
    return found


def support(votes: Column) -> Column:
    """How many of these speak for a name: what is before it, what is behind it, a title, its shape, the given and the family name; 0 where the given name is none."""
    two = lambda *at: reduce(Column.__or__, [F.substring(votes, i + 1, 1) == "2" for i in at]).cast("int")
    given_bad = F.substring(votes, 7, 1) == "0"
    return F.when(given_bad, 0).otherwise(two(0, 8) + two(1, 9) + two(2) + two(4) + two(6) + two(7))


def accept(proposed: DataFrame, rows: DataFrame, listed: set[str]) -> DataFrame:
    """The spans that the classifier accepts: the columns of KEY, and spans (p, length, kind, start, end, item) of each text.

    Cues are learned from listed names, names from cues and listed names, then the classifier is fitted on
    the vote patterns of all spans. A name needs two kinds of support besides. In one case, only what has
    two known names, or one and a cue, is proposed at all, and only by names that stand in capitals at
    least as often.
    """
    spark = proposed.sparkSession
    on_list = spark.createDataFrame([(x,) for x in sorted(listed)] or [("",)], "given string").withColumn("listed", F.lit(True))
    is_name, fixed_cue = F.col("kind") == TYPES.index("name"), F.substring("votes", 1, 3).contains("2")
    names = proposed.where(is_name).join(F.broadcast(on_list), "given", "left")
    # What stands before an initial may be a word before the name, so these spans teach nothing.
    evidence = names.where(~F.col("middle")).select("given", "family", "left", "right", "near", F.col("listed").isNotNull().alias("listed"), fixed_cue.alias("cued")).distinct()
    evidence = materialize(evidence, "evidence")
    cues = {c: materialize(learn_cues(evidence, c), f"cues-{c}") for c in ("left", "right")}
    beside = (F.coalesce(F.col("left_vote"), F.lit("1")) == "2") | (F.coalesce(F.col("right_vote"), F.lit("1")) == "2")
    evidence = materialize(voted(evidence, cues).withColumn("cued", F.col("cued") | beside), "cued")

    # Given names by cues, family names by cues and these, and given names once more by the family names too.
    good = F.col("cued") | F.col("listed")
    first = materialize(learn_names(evidence, "given", "family", good), "first-given").where("vote = '2'").select("given", F.lit(True).alias("known"))
    family = materialize(learn_names(evidence.join(first, "given", "left"), "family", "given", good | F.col("known").isNotNull()), "family")
    second = family.where("vote = '2'").select("family", F.lit(True).alias("known"))
    given = materialize(learn_names(evidence.join(second, "family", "left"), "given", "family", good | F.col("known").isNotNull()), "given")
    known = given.where("vote = '2'")

    # Listed names count as good as often as they stand in capitals before a family name that isn't against them.
    capitals = spread(evidence.where("listed"), "given", "family", good=F.col("cued").cast("long")).select("given", "good")
    able = {"given": known.select("given", "good").join(capitals, "given", "left_anti").unionByName(capitals), "family": family.where("vote = '2'").select("family", "good")}
    look = _second_look(spark, *(filter_of(x.select(c)) for c, x in able.items()))
    again = materialize(propose(rows, look), "again")
    surely = {c: rather_names(x, again, c) for c, x in able.items()}
    again = voted(again, surely | cues)
    one, two = (F.col(f"{c}_vote").isNotNull() for c in ("given", "family"))
    again = again.where((one & two) | ((one | two) & (fixed_cue | beside)))

    # A listed name counts as one, unless it is hardly ever beside a cue.
    given = given.select("given", "vote").join(on_list, "given", "full_outer")
    given = given.select("given", F.when(F.col("listed").isNull(), F.col("vote")).when(F.coalesce("vote", F.lit("2")) == "2", "2").alias("vote")).where("vote is not null")
    names = voted(names.drop("listed"), {"given": given, "family": family} | cues).unionByName(again)
    more = F.concat("votes", *[F.coalesce(f"{c}_vote", F.lit("1")) for c in ("given", "family", "left", "right")])
    columns = [*KEY, "kind", "start", "end", "item", "votes"]
    proposed = materialize(names.withColumn("votes", more).select(columns).unionByName(proposed.where(~is_name).select(columns)), "spans")
    model = spark.createDataFrame(_classify(_patterns(proposed)) or [(-1, "", 0.0)], "kind int, votes string, p double")
    model = model.where((F.col("p") > 0.5) & (~is_name | (support(F.col("votes")) >= 2)))
    kept = proposed.join(F.broadcast(model), ["kind", "votes"])
    return kept.groupBy(*KEY).agg(F.collect_set(F.struct("p", (F.col("end") - F.col("start")).alias("length"), "kind", "start", "end", "item")).alias("spans"))


def settle(found: list[dict]) -> list[dict]:
    """The spans of one text without overlaps: of names with one end the longest, names after the rest, then the most probable first."""
    longest: dict[int, int] = {}
    for s in found:
        if TYPES[s["kind"]] == "name":
            longest[s["end"]] = max(longest.get(s["end"], 0), s["length"])
    found = [s for s in found if TYPES[s["kind"]] != "name" or s["length"] == longest[s["end"]]]
    taken: list[dict] = []
    starts: list[int] = []
    for s in sorted(found, key=lambda s: (TYPES[s["kind"]] == "name", -s["p"], -s["length"], s["start"], s["kind"])):
        at = bisect.bisect(starts, s["start"])
        if (not at or taken[at - 1]["end"] <= s["start"]) and (at == len(taken) or s["end"] <= taken[at]["start"]):
            taken.insert(at, s)
            starts.insert(at, s["start"])
    return taken


SETTLED = "array<struct<kind:int,start:int,end:int,item:string>>"


def _settled(accepted: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))
        for b in batches:
            rows = [[{k: s[k] for k in ("kind", "start", "end", "item")} for s in settle(x)] for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, kind)], [*KEY, "spans"])

    return accepted.mapInArrow(run, f"rec_type string, rec_id long, text_hash long, spans {SETTLED}")


def _fill(text: str, settled: list[dict]) -> str:
    out, at = [], 0
    for s in settled:
        out += [text[at : s["start"]], f"[{TYPES[s['kind']].upper()}]"]
        at = s["end"]
    return "".join(out) + text[at:]


def redact(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """rec_type, rec_id, content with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_fill(t, s) if s else t for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["rec_type", "rec_id", "content"])

    joined = rows.join(settled, list(KEY), "left")
    return joined.select("rec_type", "rec_id", "content", "spans").mapInArrow(run, "rec_type string, rec_id long, content string")


def _find(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, sf_dir)
    listed = listed_names(spark.read.parquet(f"{sf_dir}/given_names.parquet"))
    proposed = materialize(propose(rows, _first_look(spark, listed)), "proposed")
    return rows, _settled(accept(proposed, rows, listed))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_redacted: every note and turn with content, with placeholders for personal information.

    Repeated rows stay. Null keys and null contents have no row. Spans belong to a key and its content, so
    a key with several contents has each of them redacted by its own spans.
    """
    return redact(*_find(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: one row per distinct item of a record; of a key with several contents, the items of all."""
    each = _find(spark, sf_dir)[1].select("rec_type", "rec_id", F.explode("spans").alias("s"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("s.kind") + 1)
    return each.select("rec_type", "rec_id", kind.alias("pii_type"), "s.item").distinct()
