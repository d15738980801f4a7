"""Personal data and what gives it away.

Base spans (code points, end exclusive; leftmost, non-overlapping for each kind):

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255
* card ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits

A match that fails its check is dropped without another try. Each distinct value is a *protected entity*.

The method adds ``term`` spans. A term is a run of four or more letters, lower-cased. Over the distinct texts of the
corpus it counts in how many a term occurs at all, ``n(t)``, and in how many that mention entity e it occurs, ``n(t, e)``,
wherever in the text, apart from words with digits or @. What the term says about the entity is

    p(e | t) = n(t, e) / n(t)    and    information = log2(p(e | t) / (n(e) / N))  bits.

A term seen with an entity in at least ``SUPPORT`` distinct texts discloses it when ``p >= GENERALISE`` and the information is at
least ``BITS``. All its occurrences in documents that mention the entity become spans: removed where ``p >= REMOVE``, else
generalised. Copies of a text count once, so that a page copied a thousand times doesn't make its words disclosing.

Entities that are mentioned by the same texts have the same counts for every term: they are one *group*, and only groups meet terms.
``n(t, e)`` is at most the number of texts of e, and ``n(t)`` at least the number of texts with t that mention any such entity. So entities
with too few texts, or too many for the bits, and terms too frequent for the largest entity beside them are left out before they
meet. What is left is counted in small parts of the corpus first: a term too frequent there is so in the whole, which is
counted only for terms that can still pass. All of this is exact.

Everything is DataFrame operations. Nothing pairs up the entities of a document or the documents of an entity. Counts are folded in
the map tasks, so a term or an entity with a third of all rows is one row per task. Patterns are written so that the matcher needs neither backtracking into runs nor recursion on long ones.

Defined cases: a null text is empty; ids may be null or repeat (rows are told apart by id and text; equal ones have
equal spans); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, may_be_among, stash

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 3
GENERALISE = 0.5
REMOVE = 0.9
BITS = 4.0
PARTS = [128, 16]  # shares of the texts that candidates are counted in first
TERM = "term"

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The contract's patterns. Runs are possessive and start where the run starts (or the last match ended);
#: repeated groups are lazy runs of one class up to the place where the group must end.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?<={_LABEL})(?!{_LABEL})(?!\.{_LABEL})",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?=[0-9]|[\x20-][0-9])[0-9\x20-]*?(?=[0-9](?![0-9])(?![\x20-][0-9]))[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_STEPS = 24  # running sums over up to 2**24 items


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, merge, empty: Column) -> Column:  # noqa: ANN001
    """Running totals of an array, by doubling: about log2 passes and no growing copies."""
    def step(far: int):  # noqa: ANN202
        return lambda a: F.when(F.size(a) <= far, a).otherwise(F.transform(a, lambda x, i: merge(x, F.coalesce(F.get(a, i - far), empty))))

    for s in range(_STEPS):
        values = _let(values, step(1 << s))
    return values


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches, in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)

    def place(h: Column) -> Column:
        sizes = F.transform(h, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))
        ends = _running(sizes, lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, h, lambda e, x: F.struct((e - F.length(x)).cast("long").alias("start"), e.cast("long").alias("end"), x.alias("value")))

    return _let(hits, place)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(part(p).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def base_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, t`` (a digest of the text) and an array of (start, end, value) for each kind, with the text as ``body``."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("t", F.md5("body"))
    every = {k: F.when(F.col("body").rlike(_HINTS[k]), found(F.col("body"), PATTERNS[k])).otherwise(F.array().cast(_SPAN)) for k in KINDS}
    valid = {k: F.filter(k, (lambda kind: lambda x: _valid(kind, x["value"]))(k)) for k in KINDS}
    return raw.withColumns(every).withColumns(valid)


def _terms(text: Column) -> Column:
    """Distinct terms of a text: runs of four or more letters, lower-cased."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= 4)


def _plain_terms(text: Column) -> Column:
    """Terms of a text without its words with digits or @."""
    return _terms(F.array_join(F.filter(F.split(text, r"\s+"), lambda w: ~w.rlike("[@0-9]")), " "))


def _mentions(base: DataFrame) -> DataFrame:
    """Adds ``mentions``: the distinct entities of the base spans, null if there are none."""
    def of(kind: str) -> Column:
        value = F.lower if kind == "email" else (lambda v: v) if kind == "ip" else (lambda v: F.regexp_replace(v, "[^0-9]", ""))
        return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), value(x["value"])))

    return base.withColumn("mentions", F.when(F.size(F.concat(*KINDS)) > 0, F.array_distinct(F.concat(*[of(k) for k in KINDS]))))


def entity_groups(base: DataFrame) -> DataFrame:
    """``t, group, n_e``: texts and the groups of entities they mention, for entities with enough texts, and not too many. ``base``:
    a stored table with ``t, mentions``."""
    total = base.agg(F.count_distinct("t").alias("n")).first()["n"]
    mention = base.filter("mentions is not null").select("t", F.explode("mentions").alias("entity")).distinct()
    # a set of texts is named by its size and 128 bits
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "t")) for k in (1, 2)]
    per = mention.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.struct(F.count(F.lit(1)).alias("n"), *[m.alias(f"x{k}") for k, m in enumerate(mark)]).alias("group"))
    able = per.filter((F.col("n_e") >= SUPPORT) & (2**BITS * F.col("n_e") <= total))
    return mention.join(able, "entity").select("t", "group", "n_e").distinct()


def held_texts(groups: DataFrame, docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``t, body`` of the texts in ``groups``, each once."""
    raw = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("t", F.md5("body"))
    texts = groups.select("t").distinct()
    held = may_be_among(raw, F.xxhash64("t"), texts.select(F.xxhash64("t").alias("x")), "x").join(texts, "t", "left_semi")
    return held.select("t", "body").dropDuplicates(["t"])


def _text_counts(docs: DataFrame, cand: DataFrame, text: str, part: int = 1) -> DataFrame:
    """``term, n_t``: in how many distinct texts, of one ``part``-th of them by hash, the candidates' terms occur."""
    names = cand.select("term").distinct()
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).filter(F.pmod(F.xxhash64("body"), F.lit(part)) == 0)
    words = own.select(F.md5("body").alias("t"), F.explode(_terms(F.col("body"))).alias("term"))
    thin = may_be_among(words, F.xxhash64("term"), names.select(F.xxhash64("term").alias("x")), "x")
    return thin.join(names, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosing_terms(base: DataFrame, groups: DataFrame, held: DataFrame, docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``group, term, p, bits``: the terms that disclose the entities of a group. ``base, groups, held``: stored tables."""
    most = groups.groupBy("t").agg(F.max("n_e").alias("most"))
    word = stash(held.select("t", F.explode(_plain_terms(F.col("body"))).alias("term")).join(most, "t"), "terms-beside")
    # texts with the term and any entity are among all texts with the term
    any_e = word.groupBy("term").agg(F.count(F.lit(1)).alias("n_any"), F.max("most").alias("top"))
    able = any_e.filter((F.col("n_any") >= SUPPORT) & (GENERALISE * F.col("n_any") <= F.col("top"))).select("term", "n_any")
    both = word.join(able, "term").filter(GENERALISE * F.col("n_any") <= F.col("most")).join(groups, "t").filter(GENERALISE * F.col("n_any") <= F.col("n_e"))
    joint = both.groupBy("group", "term", "n_e", "n_any").agg(F.count(F.lit(1)).alias("n_te"))
    cand = stash(joint.filter((F.col("n_te") >= SUPPORT) & (F.col("n_te") >= GENERALISE * F.col("n_any"))), "candidates")
    for part in PARTS:
        # a term that is too frequent within a part of the texts is so within all
        cand = cand.join(_text_counts(docs, cand, text, part), "term", "left").filter(GENERALISE * F.coalesce("n_t", F.lit(0)) <= F.col("n_te"))
        cand = stash(cand.drop("n_t"), "candidates")
    n_t = _text_counts(docs, cand, text)
    total = base.agg(F.count_distinct("t").alias("n"))
    p = F.col("n_te") / F.col("n_t")
    scored = cand.join(n_t, "term").join(F.broadcast(total), F.lit(True)).select(  # one row
        "group", "term", p.alias("p"), F.log2(p * F.col("n") / F.col("n_e")).alias("bits"))
    return scored.filter((F.col("p") >= GENERALISE) & (F.col("bits") >= BITS))


def _term_spans(groups: DataFrame, held: DataFrame, terms: DataFrame) -> DataFrame:
    """``t, terms`` as (start, end, value, removed) for texts with disclosing terms; equal texts have equal spans."""
    texts = groups.join(terms.select("group").distinct(), "group", "left_semi").select("t", "group")
    own = held.select("t", F.explode(_terms(F.col("body"))).alias("term")).join(terms.select("term", "group", "p"), "term")
    own = own.join(texts, ["t", "group"], "left_semi").groupBy("t", "term").agg((F.max("p") >= REMOVE).alias("removed"))
    per = own.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("m"))
    word = F.filter(found(F.col("body"), r"\p{L}+"), lambda x: F.map_contains_key("m", F.lower(x["value"])))
    spans = F.transform(word, lambda x: F.struct(x["start"], x["end"], x["value"], F.element_at("m", F.lower(x["value"])).alias("removed")))
    return held.join(per, "t").select("t", spans.alias("terms"))


def spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, t``, an array of (start, end, value) for each kind and ``terms`` (start, end, value, removed), one row per row."""
    base = stash(_mentions(base_spans(docs, doc_id=doc_id, text=text)).drop("body"), "spans")
    groups = stash(entity_groups(base), "groups")
    held = stash(held_texts(groups, docs, text=text), "held")
    terms = stash(disclosing_terms(base, groups, held, docs, text=text), "terms")
    more = _term_spans(groups, held, terms)
    both = base.drop("mentions").join(more, "t", "left")
    inside = lambda s: F.exists(F.concat(*KINDS), lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,removed:boolean>>")
    return both.withColumn("terms", F.coalesce(F.filter("terms", lambda s: ~inside(s)), none))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, one row per document."""
    name = lambda kind, a: F.transform(a, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))
    base = F.concat(*[name(k, F.col(k)) for k in KINDS])
    return spans(docs).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, name(TERM, F.col("terms"))), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rid of personal data: ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` in its place, generalised terms
    as ``[TERM]``, removed ones gone. Where spans overlap, what the earlier one leaves uncovered goes with it."""
    mark = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("put")))
    term = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["removed"], "").otherwise("[TERM]").alias("put")))
    found_ = spans(docs, doc_id=doc_id, text=text).filter(F.size(F.concat(*KINDS)) + F.size("terms") > 0)
    _t, _s, _m = free_names(docs.columns, "_t", "_s", "_m")
    cut = found_.select(F.col("t").alias(_t), F.array_sort(F.concat(*[mark(k) for k in KINDS], term)).alias(_s)).dropDuplicates([_t])
    cut = cut.withColumn(_m, _running(F.transform(_s, lambda x: x["end"]), F.greatest, F.lit(0).cast("long")))
    reach = lambda i: F.coalesce(F.get(F.col(_m), i - 1), F.lit(0).cast("long"))
    part = lambda x, i: F.when(x["start"] >= reach(i), F.concat(F.substring(text, (reach(i) + 1).cast("int"), (x["start"] - reach(i)).cast("int")), x["put"])).otherwise("")
    tail = F.substring(text, (F.get(F.col(_m), F.size(_s) - 1) + 1).cast("int"), F.length(text))
    both = docs.join(cut, F.md5(F.coalesce(docs[text], F.lit(""))) == F.col(_t), "left")
    clean = F.when(F.col(_s).isNull(), docs[text]).otherwise(F.concat(F.array_join(F.transform(_s, part), ""), tail))
    return both.select(*[clean.alias(text) if c == text else docs[c] for c in docs.columns])
