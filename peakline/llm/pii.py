"""Personal data by weak supervision, in column expressions only.

Exact patterns find addresses, IP numbers, cards and phones; those spans always stand. Looser candidates are sought in the text between those and voted on by
labelers: patterns, gazetteers and the words around. There are two families of candidates, each with labelers of its own: numbers (long digit groups, spelled-out addresses)
and secrets (long strings of letters and digits, and whatever is assigned to a password, token or key). Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler of a family is, and a logistic span classifier is trained on the resulting
posteriors. Candidates it accepts are added, and so are bank accounts (IBAN) whose check digits hold. The votes are a handful of values from a fixed set, so what reaches the driver
is one count per vote pattern, at most 3 ** (number of labelers) rows a family whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from peakline.llm.common import stored, whole_text

#: Kinds in the order in which spans are listed; `id` are accepted numbers of no exact kind.
KINDS = ("email", "ip", "card", "phone", "id", "secret", "iban")
ID, SECRET_KIND, IBAN_KIND = 4, 5, 6

# Fixed by the definition of the exact spans. Possessive quantifiers and the guards in front change no match: they keep the patterns
# linear and free of recursion on very long runs. A guard allows a start only where a run begins or the previous match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

#: Candidates: runs of digit groups with the separators people write, and addresses spelled with (at). A run ends where another character stands.
RUN = r"(?:(?<![0-9])|\G)\+?[0-9][0-9\x20()./-]{6,}+"
#: Digits that a candidate may have, and its longest extent with separators.
LEAST_DIGITS, MOST_DIGITS, MOST_CHARS = 7, 19, 62
SPELLED = r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,4}"

#: Gazetteers. Words that announce personal data in the corpus' languages, words that announce other numbers, mail hosts, dialling codes.
CONTACT = ("call|phone|phones|tel|telephone|telefon|teléfono|téléphone|mobile|mobil|móvil|portable|fax|handy|sms|whatsapp|email|e-mail|mail|courriel|correo|contact|kontakt|contacto|"
           "card|karte|carte|tarjeta|visa|mastercard|amex|kreditkarte|iban|konto|account|ssn|passport|reisepass|pasaporte|passeport")
OTHER = "isbn|issn|doi|version|order|invoice|rechnung|factura|facture|page|seite|página|sku|serial|hash|sha|token|key|id|nr|no|number|build|ticket"
MAIL_HOST = r"(?i)(?:mail|gmail|outlook|yahoo|proton|gmx|web|orange|example)"
ISSUER = r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"
DIALLING = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
DATE = r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4})(?:\x20[0-9].*)?$"

#: Secrets: strings of letters and digits as keys are written, or anything without white space that is assigned to one of the words.
SECRET_WORD = r"token|secret|passw(?:or)?d|passwort|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|contraseña|clave|kennwort|mot\x20de\x20passe"
ASSIGN = r"[\"']?\x20{0,3}(?:[:=]|:=|=>)\x20{0,3}[\"'`]?"
ANNOUNCED = rf"(?i:{SECRET_WORD})[A-Za-z0-9_-]{{0,12}}{ASSIGN}"
SECRET = rf"{ANNOUNCED}[^\x20\x09-\x0D\"'`<>,;]{{6,}}+|(?:(?<![A-Za-z0-9_+/.@-])|\G)[A-Za-z0-9_+/-]{{16,}}+={{0,2}}"
#: Public formats of access keys.
KEY_FORMAT = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})$"
NO_SECRET = "commit|sha|sha1|sha256|md5|hash|checksum|digest|etag|revision|uuid|guid|doi|isbn|integrity"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

LABELERS = ("pattern", "card_issuer", "dialling_code", "mail_host", "contact_word", "other_word", "date", "grouping", "embedded")
SECRET_LABELERS = ("key_format", "announced", "mixture", "words", "variety")


@dataclass(frozen=True)
class SpanModel:
    """A logistic span classifier over votes: weight of every labeler's vote for and against, and a constant."""

    bias: float
    votes_for: tuple[float, ...]
    votes_against: tuple[float, ...]
    reliability: tuple[tuple[float, float], ...]


def _running(lengths: Column) -> Column:
    """Sums of an array up to each element, in blocks of 64 so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 64).cast("int")), lambda b: total(F.slice(a, b * 64 + 1, F.lit(64))))
    heads = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
    bind = lambda value, use: F.transform(F.array(value), use)[0]
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(bind(lengths, lambda a: bind(blocks(a), lambda s: bind(heads(s), lambda h: F.transform(
        a, lambda _, i: F.get(h, F.floor(i / 64).cast("int")) + total(F.slice(a, F.floor(i / 64).cast("int") * 64 + 1, F.pmod(i, F.lit(64)) + 1)))))))


def located(text: Column, pattern: str) -> Column:
    """All matches as array of (start, end, hit), in code points: the pieces between the matches and the matches
    themselves add up to the text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    found = F.transform(F.array(F.struct(hits.alias("h"), pieces.alias("p"))), lambda x: F.transform(
        F.array(F.struct(x["h"].alias("h"), _running(F.transform(x["h"], lambda h, i: F.length(h) + F.length(F.get(x["p"], i)))).alias("e"))),
        lambda y: F.transform(y["h"], lambda h, i: F.struct((F.get(y["e"], i) - F.length(h)).alias("start"), F.get(y["e"], i).alias("end"), h.alias("hit"))))[0])[0]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.transform(
        F.array(F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")), lambda d: F.when(i % 2 == 0, doubled(d)).otherwise(d))[0]) % 10 == 0


def _card_ok(hit: Column) -> Column:
    return F.transform(F.array(digits(hit)), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))[0]


def _phone_ok(hit: Column) -> Column:
    return F.length(digits(hit)).between(9, 15)


def exact_spans(text: Column) -> Column:
    """Array of (kind, start, end), kind as index into KINDS, in listed order."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def of(kind: int, pattern: str, ok) -> Column:
        return F.transform(F.filter(located(text, pattern), lambda x: ok(x["hit"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    mail = F.when(F.instr(text, "@") > 0, of(0, EMAIL, lambda h: F.lit(True))).otherwise(none)
    numbers = F.when(text.rlike("[0-9]"), F.concat(of(1, IP, lambda h: h.rlike(IP_VALID)), of(2, CARD, _card_ok), of(3, PHONE, _phone_ok))).otherwise(none)
    return F.concat(mail, numbers)


def _votes(text: Column, start: Column, end: Column, hit: Column) -> Column:
    """The labelers' votes on one candidate, in the order of LABELERS: 1 for, -1 against, 0 none."""
    number, compact = digits(hit), F.trim(hit)
    before = F.lower(F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
    around = F.concat(F.substring(text, F.greatest(start, F.lit(1)), F.least(start, F.lit(1))), F.substring(text, end + 1, F.lit(1)))
    is_card, is_phone = F.length(number).between(13, 19), compact.rlike(r"^\+") & _phone_ok(hit)
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    return F.array(
        vote(compact.rlike(r"\((at)\)|\[at\]|\{at\}") | is_phone | compact.rlike(IP_VALID) | (is_card & luhn(number)), is_card & ~luhn(number)),
        vote(number.rlike(ISSUER)), vote(compact.rlike(DIALLING), compact.rlike(r"^\+0")), vote(compact.rlike(MAIL_HOST)),
        vote(before.rlike(rf"(?<![\p{{L}}])(?:{CONTACT})[\x20:.#=\"'(-]*(?:[\p{{L}}]+[\x20:.]+){{0,3}}$")), vote(F.lit(False), before.rlike(rf"(?<![\p{{L}}])(?:{OTHER})[\x20:.#=\"'(-]*$|[$€£]\x20?$")),
        vote(F.lit(False), compact.rlike(DATE)), vote(compact.rlike(r"^\+?\(?[0-9]{1,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){2,5}$"), compact.rlike(r"^[0-9]+$") & ~is_card),
        vote(F.lit(False), around.rlike(r"[\p{L}_0-9]")))


def _secret_votes(text: Column, start: Column, hit: Column) -> Column:
    """Votes on one possible secret, in the order of SECRET_LABELERS."""
    before = F.lower(F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
    letters, numbers = F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), F.length(digits(hit))
    variety = F.size(F.array_distinct(F.split(hit, "")))
    named = before.rlike(rf"(?<![\p{{L}}])(?:{NO_SECRET})[\x20:.#=\"'(-]*$|://$")  # as something that is no secret
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    return F.array(
        vote(hit.rlike(KEY_FORMAT) & ~named, named),
        vote(before.rlike(rf"{ANNOUNCED}$|bearer\x20{{1,3}}$"), ~before.rlike(rf"{ASSIGN}$") | before.rlike(r"^$")),
        vote((letters >= 4) & (numbers >= 3), (letters == 0) | (numbers == 0)),
        vote(F.lit(False), hit.rlike(r"^[A-Za-z]+[0-9]{0,4}(?:[-_/+][A-Za-z0-9]{1,12})+$|^[A-Za-z]+[0-9]{0,2}$")),
        vote((F.length(hit) >= 20) & (variety >= 10), variety < 5))


def iban_ok(hit: Column) -> Column:
    """Whether the check digits of a bank account number hold: the number behind its country, letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(hit, "\x20", "")
    turned = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    step = lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def secrets(text: Column, left: Column) -> Column:
    """Array of (start, end, votes) of the strings in `left` that may be secrets."""
    def of(left: Column) -> Column:
        # What announces a secret is not part of it.
        bare = F.transform(located(left, SECRET), lambda x: F.struct(x["end"].alias("end"), F.regexp_replace(x["hit"], rf"^{ANNOUNCED}(?=[^\x20\"'`]{{6}})", "").alias("hit")))
        placed = F.transform(bare, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))
        voted = F.transform(F.filter(placed, lambda x: x["hit"].rlike("[^0-9+/=-]")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _secret_votes(text, x["start"], x["hit"]).alias("votes")))
        any_ = left.rlike("[A-Za-z0-9_+/-]{16}") | (left.rlike("[:=]") & left.rlike(f"(?i:{SECRET_WORD})"))
        return F.when(any_, voted).otherwise(F.array().cast("array<struct<start:int,end:int,votes:array<int>>>"))

    return F.transform(F.array(left), of)[0]


def accounts(text: Column) -> Column:
    """Array of spans of bank accounts."""
    found = F.filter(located(text, IBAN), lambda x: iban_ok(x["hit"]))
    return F.transform(found, lambda x: F.struct(F.lit(IBAN_KIND).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _without(text: Column, spans: Column) -> Column:
    """The text with line breaks in place of every span, so that all positions stay."""
    blank = lambda t, s: F.overlay(t, F.repeat(F.lit("\n"), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"])
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, text, blank))


def _stretches(run: Column) -> Column:
    """Array of (start, end, hit): from every digit group of a run on, the stretches of whole groups with a candidate's digits."""
    def ahead(start: Column, piece: Column) -> Column:
        of = F.array(*(F.regexp_extract(piece, rf"^\+?(?:[0-9][\x20()./-]*+){{{n - 1}}}[0-9](?![0-9])", 0) for n in range(LEAST_DIGITS, MOST_DIGITS + 1)))
        return F.transform(F.filter(of, lambda hit: F.length(hit).between(1, MOST_CHARS)), lambda hit: F.struct((run["start"] + start).alias("start"), (run["start"] + start + F.length(hit)).alias("end"), hit.alias("hit")))

    # One character more than a candidate may have tells whether its last group is whole.
    return F.flatten(F.transform(located(run["hit"], r"\+?[0-9]++"), lambda group: F.transform(
        F.array(F.substring(run["hit"], group["start"] + 1, F.lit(MOST_CHARS + 1))), lambda piece: ahead(group["start"], piece))[0]))


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, votes, part) of everything outside the exact spans that the labelers vote on. A run of digit groups is one candidate;
    one with more digits or characters than a candidate may have is voted on by groups and stretches of consecutive groups (part)."""
    voted = lambda found, part: F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), _votes(text, x["start"], x["end"], x["hit"]).alias("votes"), F.lit(part).alias("part")))
    none = F.array().cast("array<struct<start:int,end:int,votes:array<int>,part:boolean>>")

    def of(left: Column) -> Column:
        trimmed = lambda hit: F.regexp_replace(hit, r"(?<=[0-9])[\x20()./-]++$", "")
        runs = F.transform(F.filter(located(left, RUN), lambda x: F.length(digits(x["hit"])) >= LEAST_DIGITS), lambda x: F.transform(
            F.array(trimmed(x["hit"])), lambda hit: F.struct(x["start"].alias("start"), (x["start"] + F.length(hit)).alias("end"), hit.alias("hit")))[0])
        whole = lambda x: (F.length(digits(x["hit"])) <= MOST_DIGITS) & (F.length(x["hit"]) <= MOST_CHARS)
        numbers = F.transform(F.array(runs), lambda r: F.concat(voted(F.filter(r, whole), False), voted(F.flatten(F.transform(F.filter(r, lambda x: ~whole(x)), _stretches)), True)))[0]
        return F.concat(F.when(left.rlike("[0-9]{2}|[0-9][\x20()./-]"), numbers).otherwise(none), F.when(F.instr(F.lower(left), "at") > 0, voted(located(left, SPELLED), False)).otherwise(none))

    return F.transform(F.array(_without(text, base)), of)[0]


def anchors(text: Column, base: Column) -> Column:
    """The labelers' votes on the exact spans of numbers: examples whose class is known."""
    return F.transform(F.filter(base, lambda s: s["kind"] > 0), lambda s: _votes(text, s["start"], s["end"], F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, steps: int = 400, labelers: int = len(LABELERS)) -> SpanModel:
    """The span model of one family from (votes, count) of every vote pattern.

    EM with two classes: labelers vote independently given the class, each with its own chances of voting for, against or
    not at all; it starts from the majority of votes, and one added count keeps every chance above zero. The class of what the
    first labeler, an exact pattern, decides is known and anchors the others: its matches are personal data; numbers failing a check digit, and strings announced as a hash or a link, are not. The classifier is then fitted to the
    posteriors by gradient steps on the logistic loss with a small ridge. Without candidates the model accepts nothing. A fit is `rounds` and `steps`
    passes over a table of at most 3 ** labelers rows: 19,683 rows of nine votes take two seconds.
    """
    k = labelers
    if not sum(n for _, n in patterns):
        return SpanModel(-10.0, (0.0,) * k, (0.0,) * k, ((0.5, 0.5),) * k)
    votes, n = np.array([v for v, _ in patterns]), np.array([float(c) for _, c in patterns])
    total, sigmoid = n.sum(), lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    is_ = np.stack([votes == side for side in (-1, 0, 1)], axis=2).astype(float)
    anchored, known = votes[:, 0] != 0, (votes[:, 0] == 1).astype(float)
    belief = np.where(anchored, known, sigmoid(2.0 * votes.sum(axis=1) - 1.0))
    for _ in range(rounds):
        mass = np.stack([belief, 1 - belief]) * n
        chance = (1 + np.einsum("sp,pjv->sjv", mass, is_)) / (mass.sum(axis=1) + 3)[:, None, None]
        prior = (mass.sum(axis=1) + 1) / (total + 2)
        gain = np.log(chance[0] / chance[1])
        belief = np.where(anchored, known, sigmoid(np.log(prior[0] / prior[1]) + (is_[:, 1:] * gain[1:]).sum(axis=(1, 2))))
    x = np.column_stack([np.ones(len(votes)), votes == 1, votes == -1]).astype(float)
    weights = np.zeros(2 * k + 1)
    for _ in range(steps):
        weights -= 1.5 * (0.001 * weights + (n / total * (sigmoid(x @ weights) - belief)) @ x)
    right = [(float(yes[2] / (yes[2] + no[2])), float(no[0] / (yes[0] + no[0]))) for yes, no in zip(*chance, strict=True)]
    return SpanModel(float(weights[0]), tuple(weights[1:k + 1].tolist()), tuple(weights[k + 1:].tolist()), tuple(right))


def accepted(votes: Column, model: SpanModel, threshold: float) -> Column:
    """Whether the classifier accepts a candidate; one that no labeler votes for never is."""
    score = F.lit(model.bias)
    for j, (plus, minus) in enumerate(zip(model.votes_for, model.votes_against, strict=True)):
        score = score + F.when(votes[j] == 1, plus).when(votes[j] == -1, minus).otherwise(0.0)
    return F.array_contains(votes, 1) & (score >= math.log(threshold / (1 - threshold)))


def find(docs: DataFrame, threshold: float = 0.9, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data of every document.

    Returns one row per row: doc_id (the id column), base and spans, both arrays of (kind, start, end) with kind as index into KINDS,
    in code points, ends exclusive, sorted by kind and start; and `rows`, the number of candidates. A null text is empty and has no spans. Repeated rows are
    treated alike, other columns ignored whatever their names, and an empty table gives an empty result.
    """
    text, base = F.col("text"), F.col("base")
    exact = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", "text", exact_spans(text).alias("base"))
    left = _without(text, base)
    found = stored(exact.select("doc_id", "base", candidates(text, base).alias("candidates"), anchors(text, base).alias("anchors"), secrets(text, left).alias("secrets"), accounts(text).alias("accounts")))
    # Stretches of a long run overlap, so of those only what a pattern finds is an example.
    examples = F.concat("anchors", F.transform(F.filter("candidates", lambda c: ~c["part"] | (c["votes"][0] == 1)), lambda c: c["votes"]))
    family = lambda kind, votes: F.transform(votes, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("votes")))
    each = found.select(F.explode(F.concat(family(ID, examples), family(SECRET_KIND, F.transform("secrets", lambda c: c["votes"])))).alias("e"))
    counted = sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in each.groupBy("e.kind", "e.votes").count().collect())
    model, secret_model = (fit([(v, n) for kind, v, n in counted if kind == family_], labelers=len(names)) for family_, names in ((ID, LABELERS), (SECRET_KIND, SECRET_LABELERS)))
    found = found.withColumn("taken", F.filter("candidates", lambda c: accepted(c["votes"], model, threshold)))
    # What a pattern finds in a long run stands; other stretches must not touch it nor lie in a longer one.
    touch = lambda c, o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & ((o["start"] != c["start"]) | (o["end"] != c["end"]))
    within = lambda c, o: (o["start"] <= c["start"]) & (c["end"] <= o["end"])
    stands = lambda c: ~c["part"] | (c["votes"][0] == 1) | ~F.exists("taken", lambda o: o["part"] & touch(c, o) & ((o["votes"][0] == 1) | within(c, o)))
    added = F.transform(F.filter("taken", stands), lambda c: F.struct(F.lit(KINDS.index("id")).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    hidden = F.transform(F.filter("secrets", lambda c: accepted(c["votes"], secret_model, threshold)), lambda c: F.struct(F.lit(SECRET_KIND).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.array_distinct(F.concat("base", added, hidden, "accounts"))).alias("spans"), (F.size("candidates") + F.size("secrets")).alias("rows"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one. Columns as in
    `docs`, n_chars brought up to date."""
    spans = find(docs.select(F.struct("*").alias("row"), "text"), threshold, id_col="row")
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    last = lambda a: F.get(a, F.size(a) - 1)
    merged = F.aggregate(by_start, F.array().cast("array<struct<start:int,end:int,kind:int>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (s["start"] < last(a)["end"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"), last(a)["kind"].alias("kind")))))
        .otherwise(F.concat(a, F.array(s))))
    text, name = F.coalesce(F.col("doc_id")["text"], F.lit("")), F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))
    held = spans.select(F.col("doc_id").alias("row"), merged.alias("cut"), text.alias("whole"))
    parts = F.transform("cut", lambda s, i: F.concat(F.substring(F.col("whole"), F.coalesce(F.get("cut", i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get("cut", i - 1)["end"], F.lit(0))), F.get(name, s["kind"])))
    tail = F.substring(F.col("whole"), last(F.col("cut"))["end"] + 1, F.length("whole"))
    masked = held.withColumn("masked", F.when(F.size("cut") == 0, F.col("row")["text"]).otherwise(F.concat(F.array_join(parts, ""), tail)))
    fresh = {"text": F.col("masked"), "n_chars": F.when(F.size("cut") == 0, F.col("row")["n_chars"]).otherwise(F.length("masked")) if "n_chars" in docs.columns else None}
    types = dict(docs.dtypes)
    return masked.select(*((fresh[c].cast(types[c]) if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns))
