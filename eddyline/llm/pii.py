"""Personal data by weak supervision.

Method. Patterns propose spans: base ones (email, ip, card, phone) that always stay once they pass their
checks, and looser ones (written-out addresses, national telephone numbers, card numbers inside
longer runs of digits, names after a title). Labelers vote for or against each candidate, or abstain:
two regex labelers (strict form, implausible form), a gazetteer labeler and two context labelers
(words that announce such data, words that announce other numbers). Expectation-maximisation over the counts of
vote patterns estimates every labeler's reliability and each pattern's probability. On these
probabilities a naive Bayes classifier over the span's shape, its length and the words on
either side is trained; it decides which of the looser candidates are spans.

Scale. Built-in functions only. A text is searched twice for each pattern whose cheap test it
passes, for what lies between matches and for the matches, within one scan; patterns are possessive and anchored at the ends of runs, so no text makes them quadratic. A match's
place is the running sum of the lengths before it. What reaches the driver is the table of vote patterns, at
most 5 x 3^5 rows; the classifier's table is bounded by its hash buckets.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; a looser candidate
that overlaps a base span, or an earlier candidate, is dropped; rows that repeat an id are told apart by their
texts, equal rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.llm import base

KINDS = ("email", "ip", "card", "phone", "name")
#: The kinds whose base spans are counted.
BASE = KINDS[:4]
_LOCAL = "[A-Za-z0-9._%+-]"
_AT = r"\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?"
_DOT = r"\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?"
#: (kind, whether base, cheap test, pattern). Equal in their matches to the plain greedy patterns, without backtracking.
PATTERNS = (
    ("email", True, "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"[\[(]\x20?(?:at|AT)\x20?[\])]", rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z]++)++"),
    ("phone", False, r"[0-9]{3}[.-][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    ("card", False, r"[0-9]{4}[\x20-]?[0-9]{4}", r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"),
    ("name", False, r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?"),
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GAZETTEER = {
    "email": r"\b(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "ip": r"^(?!0+\.|127\.|255\.).*$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
    "name": r"\x20(?:James|John|Robert|Michael|William|David|Mary|Anna|Maria|Linda|Laura|Peter|Paul|Hans|Pierre|Jean|Carlos|Jose|Juan|Smith|Jones|Brown|Miller|Davis|Garcia|Martin|Schmidt|Weber|Dubois|Lopez)\b",
}
ANNOUNCING = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo|address",
    "ip": r"\bip\b|host|server|address|login|adresse",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|\btel\b|mobile|fax|cell|dial|telefon|appel|llam",
    "name": "dear|contact|patient|client|signed|sincerely|regards|by",
}
OTHERWISE = r"version|\bv$|order|invoice|\bid\b|isbn|serial|number|page|chapter|release|build|section|part"
NEAR = 32
BUCKETS = 256
LEAST = 0.9


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    return F.call_function("luhn_check", _digits(c))


def _match_at(p: int):
    """What is kept of pattern p's i-th match: the text before it back to the last match, and the text after it."""
    pieces = F.col(f"pieces{p}")
    return lambda m, i: F.struct(
        F.lit(p).alias("p"), i.alias("i"), m.alias("m"), F.get(pieces, i).alias("piece"), F.substring(F.get(pieces, i + 1), 1, NEAR).alias("after")
    )


def matches(docs: DataFrame) -> DataFrame:
    """docs: id, own, text. One row for each match of a pattern, with its place and the text on either side."""
    found = []
    for p, (_, _, test, pattern) in enumerate(PATTERNS):
        has = F.col("text").contains(test) if test == "@" else F.col("text").rlike(test)
        docs = docs.withColumn(f"pieces{p}", F.when(has, F.split("text", pattern)))
        hits = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), _match_at(p))
        found.append(F.when(F.size(f"pieces{p}") > 1, hits))
    found = [F.coalesce(x, F.array().cast(docs.select(x.alias("x")).schema["x"].dataType)) for x in found]
    rows = docs.select("id", "own", F.explode(F.concat(*found)).alias("x")).select("id", "own", "x.*")
    rows = rows.select(
        "id", "own", "p", "i", "m", F.char_length("piece").alias("gap"), F.right("piece", F.lit(NEAR)).alias("before"), "after"
    ).dropDuplicates(["id", "own", "p", "i"])
    end = F.sum(F.col("gap") + F.char_length("m")).over(Window.partitionBy("id", "own", "p").orderBy("i"))
    return base.written(rows, "pii-matches").withColumn("e", end).withColumn("s", F.col("e") - F.char_length("m")).drop("gap")


def checked(rows: DataFrame) -> DataFrame:
    """Drops matches that fail their kind's checks; adds kind (its place in KINDS) and base."""
    n = F.char_length(_digits(F.col("m")))
    kind = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k, *_ in PATTERNS]), F.col("p") + 1)
    of_base = F.element_at(F.array(*[F.lit(b) for _, b, *_ in PATTERNS]), F.col("p") + 1)
    good = {
        "ip": F.col("m").rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
        "card": n.between(13, 19) & _luhn(F.col("m")),
        "phone": n.between(9, 15),
    }
    ok = F.lit(True)
    for k, test in good.items():
        ok = F.when(F.col("kind") == KINDS.index(k), test).otherwise(ok)
    return rows.withColumn("kind", kind).withColumn("base", of_base).filter(ok)


def _per_kind(tests: dict[str, Column]) -> Column:
    out = F.lit(None).cast("boolean")
    for k, test in tests.items():
        out = F.when(F.col("kind") == KINDS.index(k), test).otherwise(out)
    return out


def votes(rows: DataFrame) -> DataFrame:
    """Adds v0..v4, each 1, -1 or 0 (abstains)."""
    digits = _digits(F.col("m"))
    beside = F.lower(F.concat_ws(" ", "before", "after"))
    strict = _per_kind({
        "email": F.col("base"),
        "ip": ~F.col("m").rlike(r"(?:^|\.)0[0-9]"),
        "card": _luhn(F.col("m")) & F.col("m").rlike(r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"),
        "phone": F.col("m").rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){1,4}$"),
        "name": F.col("m").rlike(r"\x20[A-Z][a-z]+\x20[A-Z][a-z]+$"),
    })
    odd = (
        digits.rlike(r"^([0-9])\1*$|^0{4}") & (F.col("kind") != KINDS.index("name")) & (digits != "")
        | F.right("before", F.lit(1)).rlike(r"[0-9A-Za-z_]") | F.substring("after", 1, 1).rlike(r"[0-9A-Za-z_]")
    )
    known = _per_kind({k: F.col("m").rlike(p) for k, p in GAZETTEER.items()})
    told = _per_kind({k: beside.rlike(p) for k, p in ANNOUNCING.items()})
    other = F.lower("before").rlike(OTHERWISE)
    sign = lambda c, yes, no: F.when(c, yes).otherwise(no)
    ballots = (sign(strict, 1, -1), sign(odd, -1, 0), sign(known, 1, -1), sign(told, 1, 0), sign(other, -1, 0))
    return rows.withColumns({f"v{i}": F.coalesce(b, F.lit(0)) for i, b in enumerate(ballots)})


LABELERS = 5


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation. patterns: (kind, votes, how many). Returns each pattern's probability
    of being personal data. Priors: a labeler is right eight times of ten, half of the candidates are spans."""
    out = {}
    for kind in {k for k, *_ in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        share, right = 0.5, [0.8] * LABELERS
        for _ in range(rounds):
            post = []
            for v, _ in rows:
                yes, no = math.log(share), math.log(1 - share)
                for a, x in zip(right, v, strict=True):
                    if x:
                        yes += math.log(a if x > 0 else 1 - a)
                        no += math.log(1 - a if x > 0 else a)
                post.append(1 / (1 + math.exp(max(-60.0, min(60.0, no - yes)))))
            total = sum(n for _, n in rows)
            share = (sum(p * n for p, (_, n) in zip(post, rows, strict=True)) + 5) / (total + 10)
            for j in range(LABELERS):
                hit = sum(n * (p if v[j] > 0 else 1 - p) for p, (v, n) in zip(post, rows, strict=True) if v[j])
                cast = sum(n for v, n in rows if v[j])
                right[j] = min(0.99, max(0.51, (hit + 8) / (cast + 10)))
        out |= {(kind, v): p for p, (v, _) in zip(post, rows, strict=True)}
    return out


def classified(rows: DataFrame) -> DataFrame:
    """Adds score: the probability that the trained classifier gives a candidate."""
    ballots = [f"v{i}" for i in range(LABELERS)]
    counted = rows.groupBy("kind", *ballots).count().collect()  # at most 5 x 3^5 rows
    post = reliabilities([(r["kind"], tuple(r[b] for b in ballots), r["count"]) for r in counted])
    if not post:
        return rows.withColumn("score", F.lit(0.0))
    pairs = [x for (k, v), p in sorted(post.items()) for x in (F.lit(",".join(map(str, (k, *v)))), F.lit(p))]
    rows = rows.withColumn("post", F.element_at(F.create_map(*pairs), F.concat_ws(",", "kind", *ballots)))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("m", "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    hashed = lambda tag, c: F.concat(F.lit(tag), F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("string"))
    features = F.array(
        hashed("s", shape),
        F.concat(F.lit("n"), F.least(F.lit(40), F.char_length("m")).cast("string")),
        hashed("b", word("before", r"([^\x20]+)[\x20]*$")),
        hashed("a", word("after", r"^[\x20]*([^\x20]+)")),
        *[F.concat(F.lit(b), F.col(b).cast("string")) for b in ballots],
    )
    # as many rows as kinds x (3 x BUCKETS + 40 + 3 x LABELERS) at most, so to every executor
    key = ["id", "own", "p", "i"]
    spread = rows.select(*key, "kind", "post", F.explode(features).alias("f"))
    per = spread.groupBy("kind", "f").agg(F.sum("post").alias("yes"), F.sum(1 - F.col("post")).alias("no"))
    all_ = per.groupBy("kind").agg((F.sum("yes") / F.lit(4 + LABELERS)).alias("all_yes"), (F.sum("no") / F.lit(4 + LABELERS)).alias("all_no"))
    weights = per.join(F.broadcast(all_), "kind").select(
        "kind",
        "f",
        F.log(((F.col("yes") + 1) / (F.col("all_yes") + 2)) / ((F.col("no") + 1) / (F.col("all_no") + 2))).alias("w"),
        F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"),
    )
    weights = F.broadcast(base.written(weights, "pii-weights"))
    linear = spread.join(weights, ["kind", "f"]).groupBy(*key).agg((F.sum("w") + F.first("prior")).alias("x"))
    linear = linear.select(F.col("id").alias("lid"), *[F.col(c).alias(f"l{c}") for c in key[1:]], (1 / (1 + F.exp(-F.col("x")))).alias("score"))
    same = F.col("id").eqNullSafe(F.col("lid")) & (F.col("own") == F.col("lown")) & (F.col("p") == F.col("lp")) & (F.col("i") == F.col("li"))
    return rows.join(linear, same).drop("lid", "lown", "lp", "li", "post")


def spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per span: id, own (a hash of the text), kind, s, e (code points, end exclusive), m (the match),
    base, score."""
    docs = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = votes(checked(matches(docs)))
    whole = Window.partitionBy("id", "own").orderBy("s", F.desc("base"), F.desc("e"), "p")
    earlier = F.max("e").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("s"))).over(whole.rowsBetween(1, Window.unboundedFollowing))
    alone = F.coalesce(earlier <= F.col("s"), F.lit(True)) & F.coalesce(later >= F.col("e"), F.lit(True))
    rows = base.written(rows.withColumn("alone", alone).filter("base OR alone").drop("alone"), "pii-candidates")
    return classified(rows).filter(F.col("base") | (F.col("score") >= least)).select("id", "own", "kind", "s", "e", "m", "base", "score")


def redact(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (of overlapping spans, all of them by the first's kind)."""
    found = spans(docs, ident, text, least).select("id", "own", "kind", "s", "e")
    lists = found.groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("__spans"))
    of, own, listed = (base.spare(docs, n) for n in ("__id", "__own", "__spans"))
    lists = base.written(lists.withColumnsRenamed({"id": of, "own": own, "__spans": listed}), "pii-lists")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        until = F.when(fresh, F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.element_at(names, x["kind"] + 1)))
        return F.struct(until.otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    clean = F.aggregate(listed, start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = docs.join(lists, docs[ident].eqNullSafe(lists[of]) & (F.xxhash64(docs[text]) == lists[own]), "left")
    return joined.withColumn(text, F.when(F.col(listed).isNotNull(), clean).otherwise(F.col(text))).drop(of, own, listed)


def _base_of(kind: int):
    return lambda x: x["base"] & (x["kind"] == kind)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(docs)
    listed = found.groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e", "base"))).alias("x"))
    names = F.array(*map(F.lit, KINDS))
    line = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    lines = listed.select(
        F.col("id").alias("lid"),
        F.col("own").alias("lown"),
        F.concat_ws(",", F.transform("x", line)).alias("spans"),
        F.concat_ws(",", F.transform(F.filter("x", lambda x: x["base"]), line)).alias("kept"),
        *[F.size(F.filter("x", _base_of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
    )
    lines = base.written(lines, "pii-lines")
    own = docs.select("doc_id", F.xxhash64("text").alias("own"))
    out = own.join(lines, F.col("doc_id").eqNullSafe(F.col("lid")) & (F.col("own") == F.col("lown")), "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def pii_base_spans(spark, sf_dir: str) -> DataFrame:
    """What of op2_pii SQL can say: all but the spans that the method adds."""
    return op2_pii(spark, sf_dir).drop("spans")


def _matches_sql(kind: int, pattern: str, fine: str) -> str:
    """SQL for one kind's matches in d (doc_id, t): a match's place is the sum of the lengths before it."""
    at = f"list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)"
    return (
        f"SELECT doc_id, {kind} AS kind, '{KINDS[kind]}' AS name, ({at})::BIGINT AS s, m[i] AS x FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM "
        f"(SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM d)) WHERE {fine}"
    )


_DIGITS_SQL = "regexp_replace(m[i], '[^0-9]', '', 'g')"
_LUHN_SQL = (
    "list_sum(list_transform(range(1, len(<D>) + 1), lambda k: CASE WHEN k % 2 = 1 THEN <D>[len(<D>) - k + 1]::INT "
    "ELSE <D>[len(<D>) - k + 1]::INT * 2 - CASE WHEN <D>[len(<D>) - k + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
).replace("<D>", f"string_split({_DIGITS_SQL}, '')")
BASE_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (
  {_matches_sql(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
  UNION ALL {_matches_sql(1, "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "list_max(list_transform(string_split(m[i], '.'), lambda x: coalesce(try_cast(x AS UBIGINT), 256))) <= 255")}
  UNION ALL {_matches_sql(2, "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 13 AND 19 AND {_LUHN_SQL}")}
  UNION ALL {_matches_sql(3, "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 9 AND 15")}
), g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(BASE))},
    string_agg(name || ':' || s || ':' || (s + length(x)), ',' ORDER BY kind, s) AS spans FROM f GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
