"""Personal data by weak supervision. DataFrame functions only; the driver fits on a bounded table of vote patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.llm.columns import renamed

# The base patterns. Possessive forms and the conditions in front change no match; they
# keep long runs linear (a match inside a run implies one at its start or where the last match ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?){3}$"
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")

# Looser forms that only count if the votes say so, and the words that vote.
LOOSE = {
    "email": r"(?i)[a-z0-9._%+-]{1,64}+ ?[\[({] ?at ?[\])}] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[a-z0-9-]{2,24})+",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
HINT = {"email": r"(?i)[\[({] ?at ?[\])}]", "phone": r"[0-9]{3}[ .-][0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "secret": r"[0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
SHAPES = {"email": r"(?i)at.*dot|at.*\.", "phone": r"^\([0-9]{3}\) ?[0-9]{3}-|^[0-9]{3}([.-])[0-9]{3}\1", "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){4}", "secret": r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$|^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_+/-]{24,}=*$", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"}
GAZETTEER = {
    "email": r"(?i)(?:gmail|yahoo|hotmail|outlook|mail|web|gmx|proton|example)|(?:com|org|net|edu|de|fr|es|io)$",
    "phone": r"^\(?(?:2|3|4|5|6|7|8|9)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "secret": r"^(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk_|sk-|pk_|rk_|xox[abp]-|eyJ|ya29|SG)",
    "ssn": r"^[0-8]",
}
BENIGN = r"^(?:sha[0-9]+-|v[0-9]+|https?|www|[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:[A-Za-z]+[-_/])+[A-Za-z]*$)"
SPEAKS_FOR = r"(?i)(?:token|secret|api[_ -]?key|access[_ -]?key|key|passw(?:or)?d|passwort|pwd|auth|bearer|credential|clave|contrase|mot de passe|phone|tel[ée]?f?|call|fax|mobile|handy|e-?mail|contact|write|ssn|social security|iban|account|konto|compte|cuenta)"
SPEAKS_AGAINST = r"(?i)(?:commit|checksum|digest|sha-?[0-9]|md5|revision|version|build|isbn|doi|order|invoice|serial|uuid|etag|score|page)"
ASSIGNED = r"[=:]\s*[\"'“”`]?$"
LABELERS = ("shape", "gazetteer", "context", "assigned", "mixture")
LEFT = 40
STRETCH = 256
PIECE = 512


def once(value: Column, use) -> Column:
    """use(value), with value computed a single time however often use names it."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """emit(state before the item, item) for each item in order, the state starting at zero and going on by step.

    Runs in stretches of STRETCH items, whose results are joined at the end, as a list that grows
    item by item would cost the square of its length. kind is the type of what emit gives.
    """

    def stretch(own: Column, state: Column, k: Column) -> Column:
        start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        one = lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out"))
        return F.aggregate(F.slice(own, k * STRETCH + 1, F.lit(STRETCH)), start, one)

    def run(own: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(own) / F.lit(STRETCH)).cast("int") - 1)
        start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("parts"))
        more = lambda acc, k: once(stretch(own, acc["state"], k), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["parts"], F.array(r["out"])).alias("parts")))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), last), start, more, lambda acc: acc["parts"]))

    return once(items, run)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, match, left) in code points, end exclusive; left is what stands before. Linear in the text."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = once(hits, lambda h: F.arrays_zip(F.slice(gaps, 1, F.size(h)).alias("gap"), h.alias("match")))

    def emit(at: Column, p: Column) -> Column:
        start = at + F.length(p["gap"])
        end = start + F.length(p["match"])
        return F.struct(start.alias("start"), end.alias("end"), p["match"].alias("match"), F.substring(p["gap"], -LEFT, LEFT).alias("left"))

    return scan(pairs, F.lit(0), lambda at, p: at + F.length(p["gap"]) + F.length(p["match"]), emit, "struct<start:int,end:int,match:string,left:string>")


def apart(spans: Column, taken: Column) -> Column:
    """spans (start, end, match, left) that overlap none of taken (start, end), in order; one pass over both sorted by start, from either side."""

    def sweep(own: Column, others: Column) -> Column:
        tag = lambda x, mine: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(mine).alias("own"), *[(x[k] if mine else F.lit("")).alias(k) for k in ("match", "left")], F.lit(True).alias("free"))
        every = F.array_sort(F.concat(F.transform(own, lambda x: tag(x, True)), F.transform(others, lambda x: tag(x, False))))
        kind = "struct<start:int,end:int,own:boolean,match:string,left:string,free:boolean>"
        marked = lambda x, free: F.struct(*[x[k].alias(k) for k in ("start", "end", "own", "match", "left")], (x["free"] & free).alias("free"))
        ahead = scan(every, F.lit(-1), lambda far, x: F.when(x["own"], far).otherwise(F.greatest(far, x["end"])), lambda far, x: marked(x, far <= x["start"]), kind)
        behind = scan(F.reverse(ahead), F.lit(2**31 - 1), lambda near, x: F.when(x["own"], near).otherwise(F.least(near, x["start"])), lambda near, x: marked(x, near >= x["end"]), kind)
        kept = F.filter(F.reverse(behind), lambda x: x["own"] & x["free"])
        return F.transform(kept, lambda x: F.struct(*[x[k].alias(k) for k in ("start", "end", "match", "left")]))

    return once(spans, lambda own: F.when(F.size(own) == 0, own).otherwise(once(taken, lambda others: F.when(F.size(others) == 0, own).otherwise(sweep(own, others)))))


NO_SPANS = "cast(array() as array<struct<start:int,end:int,match:string,left:string>>)"


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.expr(NO_SPANS))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans by kind; matches that fail their check are dropped, not tried again."""
    count = lambda m: F.length(_digits(m))
    return {
        "email": _if(text.contains("@"), found(text, EMAIL)),
        "ip": _if(text.rlike(r"[0-9]\.[0-9]"), F.filter(found(text, IP), lambda x: x["match"].rlike(IP_PARTS))),
        "card": _if(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(found(text, CARD), lambda x: F.when(count(x["match"]).between(16, 19), luhn(_digits(x["match"]))).otherwise(False))),
        "phone": _if(text.rlike(r"\+[0-9]"), F.filter(found(text, PHONE), lambda x: count(x["match"]).between(8, 15))),
    }


def _votes(kind: str, match: Column, left: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, -1, or 0 to abstain."""
    return {
        "shape": F.when(match.rlike(SHAPES[kind]), 1).otherwise(-1),
        "gazetteer": F.when(match.rlike(GAZETTEER[kind]), 1).when(match.rlike(BENIGN), -1).otherwise(0),
        "context": F.when(left.rlike(SPEAKS_FOR), 1).when(left.rlike(SPEAKS_AGAINST), -1).otherwise(0),
        "assigned": F.when(left.rlike(ASSIGNED), 1).otherwise(0),
        "mixture": F.when(match.rlike(r"[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]"), 1).otherwise(-1 if kind == "secret" else 0),
    }


def _candidate(kind: str):
    def make(x: Column) -> Column:
        votes = F.concat_ws(",", *[v.cast("string") for v in _votes(kind, x["match"], x["left"]).values()])
        size = F.least(F.lit(4), F.floor((x["end"] - x["start"]) / 12)).cast("int")
        letters = F.when(x["match"].rlike("[a-z]"), 1).otherwise(0) + F.when(x["match"].rlike("[A-Z]"), 2).otherwise(0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), votes.alias("votes"), size.alias("size"), letters.alias("letters"))

    return make


def loose_spans(text: Column) -> dict[str, Column]:
    """Matches of the loose patterns by kind; a secret has digits and letters."""
    out = {kind: _if(text.rlike(HINT[kind]), found(text, pattern)) for kind, pattern in LOOSE.items()}
    out["secret"] = F.filter(out["secret"], lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]"))
    return out


def candidates(base: list[Column], loose: dict[str, Column]) -> Column:
    """Loose candidates that overlap no base span and none of a kind listed before in LOOSE: (kind, start, end, votes, size class, letters), votes as one string."""
    ends = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    taken, out = list(base), []
    for kind, spans in loose.items():
        out.append(F.transform(apart(spans, F.concat(*taken)), _candidate(kind)))
        taken.append(ends(spans))
    return F.concat(*out)


class Classifier:
    """Logistic regression of a candidate's class on its kind, votes, size and letters."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def chosen(self, spans: Column) -> Column:
        """The candidates that the classifier takes for personal data."""
        if not self.weights:
            return F.filter(spans, lambda x: F.lit(False))
        keys, values = F.array(*[F.lit(k) for k in self.weights]), F.array(*[F.lit(float(v)) for v in self.weights.values()])
        weight = lambda name: F.coalesce(F.get(values, F.array_position(keys, name).cast("int") - 1), F.lit(0.0))

        def logit(x: Column) -> Column:
            votes = F.split(x["votes"], ",")
            total = weight(F.lit("bias")) + weight(F.concat(F.lit("kind="), x["kind"])) + weight(F.concat(F.lit("size="), x["size"].cast("string"))) + weight(F.concat(F.lit("letters="), x["letters"].cast("string")))
            for i, name in enumerate(LABELERS):
                total = total + weight(F.concat(F.lit(f"{name}="), F.get(votes, F.lit(i))))
            return total

        return F.filter(spans, lambda x: logit(x) >= 0)


def _names(kind: str, votes: str, size: int, letters: int) -> list[str]:
    return ["bias", f"kind={kind}", f"size={size}", f"letters={letters}", *(f"{n}={v}" for n, v in zip(LABELERS, votes.split(","), strict=True))]


def expectation_maximisation(patterns: list[tuple[str, str, int, int, int]], rounds: int = 30) -> list[float]:
    """Each pattern's chance to be personal data, given the reliabilities that EM estimates for the labelers.

    patterns: (kind, votes, size, letters, count). Starts from the share of votes in favour; each
    labeler has its own chance of every vote under either class, each kind its own prior; all
    smoothed by one or two invented cases of the evident meaning.
    """
    votes = [[int(v) for v in p[1].split(",")] for p in patterns]
    counts = [p[4] for p in patterns]
    chance = [(1 + sum(v > 0 for v in vs)) / (2 + sum(v != 0 for v in vs)) for vs in votes]
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        table = [{(v, c): (2.0 if v * (2 * c - 1) > 0 else 1.0) for v in (-1, 0, 1) for c in (0, 1)} for _ in LABELERS]
        for p, vs, n, q in zip(patterns, votes, counts, chance, strict=True):
            own = prior.setdefault(p[0], [1.0, 1.0])
            own[1] += n * q
            own[0] += n * (1 - q)
            for t, v in zip(table, vs, strict=True):
                t[v, 1] += n * q
                t[v, 0] += n * (1 - q)
        total = [{c: sum(t[v, c] for v in (-1, 0, 1)) for c in (0, 1)} for t in table]
        for i, (p, vs) in enumerate(zip(patterns, votes, strict=True)):
            odds = math.log(prior[p[0]][1] / prior[p[0]][0])
            for t, s, v in zip(table, total, vs, strict=True):
                odds += math.log(t[v, 1] / s[1]) - math.log(t[v, 0] / s[0])
            chance[i] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return chance


def train(patterns: list[tuple[str, str, int, int, int]], steps: int = 400) -> Classifier:
    """The span classifier, fitted to the EM chances of the vote patterns; each pattern weighs by the logarithm of its count."""
    if not patterns:
        return Classifier({})
    target = expectation_maximisation(patterns)
    names = [_names(*p[:4]) for p in patterns]
    mass = [1 + math.log(p[4]) for p in patterns]
    weights = dict.fromkeys(sorted({n for own in names for n in own}), 0.0)
    rate = 2.0 / sum(mass)
    for _ in range(steps):
        slope = dict.fromkeys(weights, 0.0)
        for own, y, m in zip(names, target, mass, strict=True):
            z = sum(weights[n] for n in own)
            error = m * (y - 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
            for n in own:
                slope[n] += error
        for n in weights:
            weights[n] += rate * slope[n]
    return Classifier(weights)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii_email, pii_ip, pii_card, pii_phone (base spans) and pii_loose (candidates).

    Null and empty texts have none; equal texts get equal spans; repeated rows stay; an empty table
    gives no rows. Columns starting with pii_ are reserved. Work grows in proportion to the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, loose = base_spans(text), loose_spans(text)
    out = docs.withColumns({f"pii_{k}": F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k, c in base.items()} | {f"pii_like_{k}": c for k, c in loose.items()})
    return out.withColumn("pii_loose", candidates([F.col(f"pii_{k}") for k in base], {k: F.col(f"pii_like_{k}") for k in loose})).drop(*[f"pii_like_{k}" for k in loose])


def fit(detected: DataFrame) -> Classifier:
    """EM and the classifier over the vote patterns of all candidates; none give a classifier that takes nothing.

    The driver gets one row per pattern, of at most some thousand that exist, in sorted order, so
    neither the order nor the partitions of rows matter. Null lists count as empty.
    """
    rows = detected.where(F.size("pii_loose") > 0).select(F.explode("pii_loose").alias("c")).groupBy("c.kind", "c.votes", "c.size", "c.letters").agg(F.count("*").alias("n")).collect()
    return train(sorted((r["kind"], r["votes"], r["size"], r["letters"], r["n"]) for r in rows))


def _all_spans(model: Classifier) -> tuple[Column, Column]:
    """(base, all) as arrays of (kind, start, end), by kind as listed, then start."""
    tagged = lambda name, k: F.transform(name, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.concat(*[tagged(f"pii_{k}", k) for k in KINDS[:4]])
    more = F.transform(model.chosen(F.col("pii_loose")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    place = lambda k: sum((F.when(k == name, i).otherwise(0) for i, name in enumerate(KINDS)), F.lit(0))
    ranked = F.array_sort(F.transform(F.concat(base, more), lambda x: F.struct(place(x["kind"]).alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return base, F.transform(ranked, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of docs.

    The base patterns' spans always stay; looser candidates are voted on by regex, gazetteer and
    context labelers, whose reliabilities expectation-maximisation estimates from all candidates of
    all documents, and are added if the classifier trained on the result takes them. n_ and
    base_sha256 cover base spans alone, spans all.

    Null and empty texts have no spans; null and repeated ids stay; ties and repeated rows get equal
    results; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(detect(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text"))
    base, every = _all_spans(fit(rows))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]], F.sha2(line(base), 256).alias("base_sha256"), line(every).alias("spans"))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start up to end, of a text given in blocks of PIECE code points."""
    i, j = F.floor(start / F.lit(PIECE)).cast("int"), F.floor((end - 1) / F.lit(PIECE)).cast("int")
    head = F.substring(F.get(blocks, i), start - i * PIECE + 1, F.when(i == j, end - start).otherwise(F.lit(PIECE)))
    tail = F.substring(F.get(blocks, j), F.lit(1), end - j * PIECE)
    middle = F.array_join(F.slice(blocks, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
    return F.when(end <= start, F.lit("")).when(i == j, head).otherwise(F.concat(head, middle, tail))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets, as [EMAIL]; of overlapping spans the first (then longest) names the whole.

    Texts are searched once; what was found is kept in the shared folder until the classifier is
    fitted. Other columns stay; rows without spans are unchanged, null texts stay null, repeated rows
    stay, and an empty table gives no rows. Columns may have any names. Work grows in proportion to
    the text.
    """
    own, (own_text,) = renamed(docs, text_col)
    return _masked(own, own_text).toDF(*docs.columns)


def _masked(docs: DataFrame, text_col: str) -> DataFrame:
    detected = cut(detect(docs, text_col))
    _, every = _all_spans(fit(detected))
    text = F.col(text_col)
    ordered = F.array_sort(F.transform("pii_all", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def replaced(blocks: Column) -> Column:
        put = lambda at, x: F.when(x["start"] >= at, F.concat(part(blocks, at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        pieces = scan(ordered, F.lit(0), lambda at, x: F.greatest(at, x["end"]), put, "string")
        return F.concat(F.array_join(pieces, ""), part(blocks, F.array_max(F.transform("pii_all", lambda x: x["end"])), F.length(text)))

    masked = once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), replaced)
    return detected.withColumn("pii_all", every).withColumn(text_col, F.when(F.size("pii_all") > 0, masked).otherwise(text)).select(*docs.columns)
