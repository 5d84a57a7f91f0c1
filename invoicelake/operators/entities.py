"""Entity evidence (E0-E8): spans scored, matched with keywords, reduced to one row
per document.

The built-in tagger's evidence is found within the scan (``with_text_evidence``).
For spans of any other tagger there are joins:

Spans and tokens are tables.  Joins between them use the document *and* the
token position as key, so a document with very many spans is spread over many
tasks; everything that picks one row of many is an aggregate, which combines on
the map side, and not a window over whole documents.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions.columns import first_of, let, per_application, pinned
from invoicelake.functions.normalize import detect_currency, normalize_amount, normalize_date, round2
from invoicelake.functions.text import clean_text, head_lines, strip

EVIDENCE_TYPE = (
    "struct<org:struct<value:string,confidence:double>,"
    "date_near:struct<value:date,confidence:double>,"
    "date_best:struct<value:date,confidence:double>,"
    "due_near:array<struct<value:date,confidence:double>>,"
    "total_near:struct<value:double,confidence:double>,"
    "money_best:struct<value:double,confidence:double>,"
    "money_currency:string>"
)

# --- E0: a stand-in for a tagger ---------------------------------------------

_TOKEN = r"\p{N}+(?:[-/'#.,]\p{N}+)+|[\p{L}\p{N}_]+(?:[-/'#][\p{L}\p{N}_]+)*|\S"
_DATE_SPAN = (
    r"(?<![\w.,/-])(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2}|\d{1,2} (?:"
    + V.MONTHS + r") \d{4}|(?:" + V.MONTHS + r") \d{1,2},? \d{4})(?![\w/-]|[.,]\d)"
)
_MONEY_SPAN = (
    r"(?:[\$£€₹¥]|\b(?:" + "|".join(V.CURRENCY_CODES) + r")\b) ?"
    r"(?:\d{1,3}(?: \d{3})+(?!\d)(?:[,.]\d{1,2})?|\d+(?:[,.]\d{2,3})*(?:[,.]\d{1,2})?)(?![.,]?\d)"
)
_ORG_SPAN = (
    r"\b\p{Lu}[\w#&'.-]*(?: \p{Lu}[\w#&'.-]*)* "
    r"(?:Ltd|Limited|Inc|LLC|LLP|Corp|Corporation|GmbH|PLC|AG|BV)\b\.?"
)
_NUMBER_SPAN = r"(?<![\w.,#/-])\d+(?:[.,]\d+)*(?![\w#/'-]|[.,]\d)"
# spans start with a digit, a capital letter or a symbol, so all else is a token without trying them
_SPAN = "(?U)" + "|".join(
    [r"(?![\d\p{Lu}\$£€₹¥])(?:" + _TOKEN + ")", _DATE_SPAN, _MONEY_SPAN, _ORG_SPAN, _NUMBER_SPAN, _TOKEN]
)
#: A number with at most one separator is one token, and no date, which has two.
_PLAIN_NUMBER = r"\A\d+(?:[.,]\d+)?\z"


def _may_be_span(chunk: Column) -> Column:
    """Spans start with a digit or a symbol or hold a blank; anything outside ASCII is looked at."""
    digit, foreign = (chunk >= "0") & (chunk < ":"), chunk >= "\x80"
    return digit | foreign | F.startswith(chunk, F.lit("$")) | F.contains(chunk, F.lit(" "))


def _label(chunk: Column) -> Column:
    def whole(pattern: str) -> Column:
        return chunk.rlike(r"(?U)\A(?:" + pattern + r")\z")

    return (
        F.when(whole(_DATE_SPAN), "DATE")
        .when(whole(_MONEY_SPAN), "MONEY")
        .when(whole(_ORG_SPAN), "ORG")
        .when(whole(_NUMBER_SPAN), "CARDINAL")
    )


def _cut(clean: Column) -> Column:
    """Each text as one array of tokens; the first token of a span carries it.

    The text is cut into spans and single tokens in one scan, then spans into
    tokens, so positions are array indexes and no row leaves its document.
    """
    chunks = F.regexp_extract_all(clean, F.lit(_SPAN), F.lit(0))
    nothing = F.lit(None).cast("string")

    def cell(token: Column, label: Column, text: Column) -> Column:
        return F.struct(token.alias("token"), label.alias("label"), text.alias("text"))

    def of_span(text: Column, label: Column) -> Column:
        tokens_of = F.regexp_extract_all(text, F.lit("(?U)" + _TOKEN), F.lit(0))
        parts = F.transform(tokens_of, lambda t, i: cell(t, F.when(i == 0, label), F.when(i == 0, text)))
        return F.when(label.isNull(), F.array(cell(text, nothing, nothing))).otherwise(parts)

    def cells(c: Column) -> Column:
        # what is no span is one token
        return (
            F.when(~_may_be_span(c), F.array(cell(c, nothing, nothing)))
            .when(c.rlike(_PLAIN_NUMBER), F.array(cell(c, F.lit("CARDINAL"), c)))
            .otherwise(let(_label(c), lambda label: of_span(c, label)))
        )

    return F.flatten(F.transform(chunks, cells))


@per_application
def _cut_of_raw() -> Column:
    return _cut(clean_text(F.coalesce(F.col("raw_text"), F.lit(""))))


def annotated(docs: DataFrame) -> DataFrame:
    """(doc_id, cut), the tokens of a text with the spans they start.

    ``tokens`` and ``tag_entities`` take it in place of texts, so that a text is
    cut once for both; written, it is read by as many steps as need it.
    """
    return docs if "cut" in docs.columns else docs.select("doc_id", pinned(_cut_of_raw()).alias("cut"))


def tokens(docs: DataFrame) -> DataFrame:
    """Table (doc_id, tok_no, token) of texts, or of what ``annotated`` made of them."""
    rows = annotated(docs).select("doc_id", F.posexplode("cut").alias("tok_no", "t"))
    return rows.select("doc_id", "tok_no", F.col("t.token").alias("token"))


def tag_entities(docs: DataFrame) -> DataFrame:
    """Table (doc_id, ent_no, start_tok, label, text) by rules, in place of a model."""
    numbered = F.transform(
        F.col("cut"),
        lambda t, i: F.struct(i.alias("start_tok"), t["label"].alias("label"), t["text"].alias("text")),
    )
    spans = F.filter(numbered, lambda t: t["label"].isNotNull())
    found = annotated(docs).select("doc_id", pinned(spans).alias("spans"))
    rows = found.select("doc_id", F.posexplode("spans").alias("ent_no", "e"))
    return rows.select("doc_id", "ent_no", "e.start_tok", "e.label", "e.text")


# --- E1-E4: scored entities ---------------------------------------------------


def _labelled(entities: DataFrame, *labels: str) -> DataFrame:
    return entities.filter(F.col("label").isin(*labels)).withColumn("text", strip(F.col("text"))).filter(
        F.col("text") != ""
    )


def _distinct(spans: DataFrame, *extra: str) -> DataFrame:
    """First span of each text of a document."""
    picked = [F.min_by(c, "ent_no").alias(c) for c in extra]
    return spans.groupBy("doc_id", "text").agg(F.min("ent_no").alias("ent_no"), *picked)


def _sum(base: Column | float, *parts: tuple[Column, float]) -> Column:
    total = base if isinstance(base, Column) else F.lit(base)
    for condition, amount in parts:
        total = F.when(condition, total + F.lit(amount)).otherwise(total)
    return F.least(F.round(total, 2), F.lit(1.0))


def score_orgs(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Organisations with their confidence."""
    spans = _distinct(_labelled(entities, "ORG"))
    top = docs.select("doc_id", head_text(clean_text(F.coalesce("raw_text", F.lit("")))).alias("top"))
    confidence = _org_confidence(F.col("text"), F.coalesce("top", F.lit("")))
    return spans.join(top, "doc_id", "left").select(
        "doc_id", "ent_no", F.lit("ORG").alias("label"), "text", confidence.alias("confidence")
    )


def head_text(clean: Column) -> Column:
    return F.lower(F.array_join(head_lines(clean, V.ORG_HEADER_LINES), "\n"))


def _org_confidence(text: Column, top: Column) -> Column:
    s = V.ORG_SCORES
    long = F.length(text) > V.SHORT_ORG_CHARS
    return _sum(
        s["base"],
        (text.rlike(V.ENTITY_ORG_SUFFIX), s["suffix"]),
        (F.contains(top, F.lower(text)), s["header"]),
        (~long, s["short"]),
        ((text == F.lower(text)) & long, s["lower"]),
    )


def score_dates(entities: DataFrame) -> DataFrame:
    """Absolute dates with their confidence."""
    spans = _distinct(_labelled(entities, "DATE").filter(~F.col("text").rlike(V.ENTITY_RELATIVE_DATE)))
    return spans.select(
        "doc_id", "ent_no", F.lit("DATE").alias("label"), "text", _date_confidence(F.col("text")).alias("confidence")
    )


def _date_confidence(text: Column) -> Column:
    s = V.DATE_SCORES
    return _sum(
        s["base"],
        (text.rlike(V.ENTITY_YEAR), s["year"]),
        (text.rlike(V.ENTITY_MONTH), s["month"]),
        (text.rlike(V.ENTITY_NUMERIC_DATE), s["numeric"]),
        (~text.rlike(r"(?U)\s"), s["one_word"]),
    )


def score_money(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Amounts with their confidence; bare numbers only behind a currency mark."""
    spans = _labelled(entities, "MONEY", "CARDINAL")
    marks = tokens.filter(F.col("token").rlike(V.ENTITY_CURRENCY)).select(
        "doc_id", (F.col("tok_no") + 1).alias("start_tok")
    )
    bare = spans.filter((F.col("label") == "CARDINAL") & F.col("text").rlike(V.ENTITY_NUMBER_LIKE)).join(
        marks, ["doc_id", "start_tok"], "left_semi"
    )
    named = spans.filter(F.col("label") == "MONEY").select(bare.columns)
    kept = _distinct(named.unionByName(bare), "label")
    confidence = _money_confidence(F.col("label"), F.col("text"))
    return kept.select("doc_id", "ent_no", "label", "text", confidence.alias("confidence"))


def _money_confidence(label: Column, text: Column) -> Column:
    s = V.MONEY_SCORES
    mark = text.rlike(V.ENTITY_CURRENCY)
    return _sum(
        F.when(label == "MONEY", s["money"]).otherwise(s["cardinal"]),
        (mark, s["currency"]),
        (text.rlike(V.ENTITY_DECIMALS), s["decimals"]),
        (text.rlike(V.ENTITY_SPELLED_OUT) & ~mark, s["spelled_out"]),
    )


# --- E5, E6: entities behind a keyword ----------------------------------------


def keyword_list(kind: str, keywords: list[str], label: str, window: int) -> list[tuple]:
    return [(kind, no, word, label, window) for no, word in enumerate(keywords)]


KEYWORDS = (
    keyword_list("invoice_date", V.INVOICE_DATE_KEYWORDS, "DATE", V.INVOICE_DATE_WINDOW)
    + keyword_list("due_date", V.DUE_DATE_KEYWORDS, "DATE", V.DUE_DATE_WINDOW)
    + keyword_list("total_amount", V.TOTAL_KEYWORDS, "MONEY", V.TOTAL_WINDOW)
)


def near_keywords(tokens: DataFrame, entities: DataFrame, keywords: list[tuple] = KEYWORDS) -> DataFrame:
    """E5: per document and keyword the first keyword token that has an entity of the
    label within the window, and the nearest such entity.

    A range join: positions are cut into blocks as wide as the widest window, a
    keyword token looks into its own block and the next, and the exact window is
    checked behind the equality on (document, label, block).
    """
    width = max(window for *_, window in keywords)
    entry = "struct<kind:string,kw_no:int,keyword:string,label:string,window:int>"
    table = F.array(*[F.struct(*map(F.lit, row)).cast(entry) for row in keywords])
    wanted = tokens.withColumn("word", F.lower("token")).filter(
        F.col("word").isin(sorted({row[2] for row in keywords}))
    )
    first_block = F.floor(F.col("tok_no") / width).cast("int")
    looking = (
        wanted.select(
            "doc_id",
            "tok_no",
            F.explode(F.filter(table, lambda k: k["keyword"] == F.col("word"))).alias("k"),
        )
        .select(
            "doc_id", "tok_no", "k.kind", "k.kw_no", "k.label", "k.window",
            F.explode(F.array(first_block, first_block + 1)).alias("block"),
        )
    )
    spans = entities.filter(F.col("label").isin(sorted({row[3] for row in keywords}))).select(
        "doc_id", "label", "start_tok", "text", F.floor(F.col("start_tok") / width).cast("int").alias("block")
    )
    distance = F.col("start_tok") - F.col("tok_no")
    found = looking.join(spans, ["doc_id", "label", "block"]).filter(
        (distance >= 0) & (distance < F.col("window"))
    )
    nearest = found.groupBy("doc_id", "kind", "kw_no", "window").agg(
        F.min(F.struct("tok_no", "start_tok", "text")).alias("hit")
    )
    gap = F.col("hit.start_tok") - F.col("hit.tok_no")
    return nearest.select(
        "doc_id",
        "kind",
        "kw_no",
        strip(F.col("hit.text")).alias("text"),
        gap.alias("distance"),
        _near_confidence(gap, F.col("window")).alias("confidence"),
    )


def _near_confidence(gap: Column, window: Column) -> Column:
    bonus = round2((window - gap) / window * V.NEAR_BONUS)
    return F.round(F.lit(V.NEAR_BASE) + bonus, 2)


def near_confidences(window: int) -> Column:
    """``_near_confidence`` of every gap that a window has, as an array of literals."""
    bonuses = [round((window - gap) / window * V.NEAR_BONUS, 2) for gap in range(window)]
    sums = [Decimal(repr(V.NEAR_BASE + bonus)).quantize(Decimal("0.01"), ROUND_HALF_UP) for bonus in bonuses]
    return F.array(*[F.lit(float(x)) for x in sums])


# --- E7, E8: one row per document ---------------------------------------------


def _pair(value: str) -> Column:
    return F.struct(F.col(value).alias("value"), F.col("confidence"))


def _best(condition: Column, value: str) -> Column:
    """Highest confidence first, the earlier span on a tie."""
    return F.max_by(F.when(condition, _pair(value)), F.when(condition, F.struct("confidence", -F.col("rank"))))


def _first(condition: Column, value: str) -> Column:
    """The first keyword of the list that has a value."""
    return F.min_by(F.when(condition, _pair(value)), F.when(condition, F.col("rank")))


def evidence(docs: DataFrame, tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """All that the extractors want to know about a document's entities."""
    columns = ["doc_id", "kind", "rank", "text", "confidence"]
    scored = score_orgs(entities, docs).unionByName(score_dates(entities)).unionByName(
        score_money(entities, tokens).withColumn("label", F.lit("MONEY"))
    )
    near = near_keywords(tokens, entities)
    facts = scored.select(
        "doc_id", F.concat(F.lit("best_"), "label").alias("kind"), F.col("ent_no").alias("rank"), "text",
        "confidence",
    ).unionByName(
        near.select(
            "doc_id", F.concat(F.lit("near_"), "kind").alias("kind"), F.col("kw_no").alias("rank"), "text",
            "confidence",
        )
    )
    return facts.select(*columns, *_read_facts()).groupBy("doc_id").agg(*_evidence_columns())


@per_application
def _read_facts() -> list[Column]:
    kind, text = F.col("kind"), F.col("text")
    dates, money = ["best_DATE", "near_invoice_date", "near_due_date"], ["best_MONEY", "near_total_amount"]
    return [
        F.when(kind.isin(dates), normalize_date(text)).alias("date"),
        F.when(kind.isin(money), normalize_amount(text)).alias("amount"),
        F.when(kind == "best_MONEY", detect_currency(text)).alias("currency"),
    ]


@per_application
def _evidence_columns() -> list[Column]:
    kind = F.col("kind")
    has_date, has_amount = F.col("date").isNotNull(), F.col("amount").isNotNull()
    due = F.when(
        (kind == "near_due_date") & has_date, F.struct(F.col("rank"), F.col("date").alias("value"), "confidence")
    )
    return [
        _best(kind == "best_ORG", "text").alias("org"),
        _first((kind == "near_invoice_date") & has_date, "date").alias("date_near"),
        _best((kind == "best_DATE") & has_date, "date").alias("date_best"),
        F.transform(
            # at most one row per keyword
            F.sort_array(F.collect_list(due)),
            lambda d: F.struct(d["value"].alias("value"), d["confidence"].alias("confidence")),
        ).alias("due_near"),
        _first((kind == "near_total_amount") & has_amount, "amount").alias("total_near"),
        _best((kind == "best_MONEY") & has_amount, "amount").alias("money_best"),
        _best((kind == "best_MONEY") & F.col("currency").isNotNull(), "currency")["value"].alias(
            "money_currency"
        ),
    ]


# --- E8 in one pass -------------------------------------------------------------

_ADDED = ("_tokens", "_spans", "_keywords", "_orgs", "_dates", "_money", "_org", "_date", "_sum")
_VALUES = {"DATE": "date", "MONEY": "double"}


def evidence_type(extra: tuple[tuple, ...] = ()) -> str:
    """Type of ``evidence``; each kind of ``extra`` keywords adds a value with its confidence."""
    more = {kind: _VALUES[label] for kind, _, _, label, _ in extra}
    added = "".join(f",{kind}:struct<value:{dtype},confidence:double>" for kind, dtype in more.items())
    return EVIDENCE_TYPE[:-1] + added + ">"


def with_text_evidence(texts: DataFrame, extra: tuple[tuple, ...] = ()) -> DataFrame:
    """``texts(.., clean_text)`` with the column ``evidence`` of the built-in tagger.

    What ``evidence`` finds by joins is found within each row, so the texts are
    read once and nothing leaves the scan.  ``extra`` are further keywords, of
    kinds of their own.
    """
    cut = texts.withColumn("_cut", pinned(_cut_of_clean()))
    spans = F.transform(
        "_cut",
        lambda t, i: F.when(
            t["label"].isNotNull(),
            F.struct(i.alias("no"), i.alias("at"), t["label"].alias("label"), strip(t["text"]).alias("text")),
        ),
    )
    placed = cut.withColumns(
        {
            "_tokens": pinned(F.transform("_cut", lambda t: t["token"])),
            "_spans": pinned(F.filter(spans, lambda s: s.isNotNull())),
            "_top": head_text(F.col("clean_text")),
        }
    )
    return with_row_evidence(placed.drop("_cut"), extra).drop("_top")


def tagged_rows(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Tables of a tagger as one row per document: (doc_id, _tokens, _spans).

    ``tok_no`` counts the tokens of a document from 0.  Both tables are only
    grouped and joined by document, so tables bucketed by it are not shuffled.
    """
    token = F.struct("tok_no", "token")
    span = F.struct(
        F.col("ent_no").alias("no"), F.col("start_tok").alias("at"), "label", strip(F.col("text")).alias("text")
    )
    by_doc = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(token)).alias("_tokens"))
    spans = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    return by_doc.join(spans, "doc_id").select(
        "doc_id", F.transform("_tokens", lambda t: t["token"]).alias("_tokens"), "_spans"
    )


def with_row_evidence(rows: DataFrame, extra: tuple[tuple, ...] = ()) -> DataFrame:
    """Rows with ``_tokens``, ``_spans`` (by number) and ``_top``, the lower-case head lines, with ``evidence``.

    Keywords and spans of a label are merged into one array in order of
    position; the span nearest behind a keyword is among the next events of
    it, as many as the window is wide.  The work grows with the tokens.
    """
    for stage in _evidence_stages(extra):
        rows = rows.withColumns({name: pinned(column) for name, column in stage.items()})
    windows = _windows(extra)
    return rows.drop(*_ADDED, *(f"_near_{label}_{n}" for label, n in windows), *(f"_events_{label}" for label, _ in windows))


def _windows(extra: tuple[tuple, ...]) -> list[tuple[str, int]]:
    return sorted({(label, window) for *_, label, window in (*KEYWORDS, *extra)})


@per_application
def _cut_of_clean() -> Column:
    return _cut(F.col("clean_text"))


@per_application
def _evidence_stages(extra: tuple[tuple, ...]) -> list[dict[str, Column]]:
    spans, windows, entries = F.col("_spans"), _windows(extra), (*KEYWORDS, *extra)
    keywords = sorted({word for _, _, word, _, _ in entries})
    # only keywords are made rows
    words = F.transform(
        "_tokens",
        lambda t, i: F.when(F.lower(t).isin(keywords), F.struct(i.alias("at"), F.lower(t).alias("word"))),
    )

    def texts_of(keep) -> Column:
        """Each text once, by its first span."""
        return F.array_distinct(F.transform(F.filter(spans, lambda s: keep(s) & (s["text"] != "")), lambda s: s["text"]))

    def is_amount(s: Column) -> Column:
        behind_mark = F.get(F.col("_tokens"), s["at"] - 1).rlike(V.ENTITY_CURRENCY)
        bare = (s["label"] == "CARDINAL") & s["text"].rlike(V.ENTITY_NUMBER_LIKE) & behind_mark
        return (s["text"] != "") & ((s["label"] == "MONEY") | bare)

    # the first span of each text: its number decides ties, and of amounts its label
    amounts = F.sort_array(
        F.transform(
            F.filter(spans, is_amount),
            lambda s: F.struct(s["text"].alias("text"), s["no"].alias("no"), s["label"].alias("label")),
        )
    )
    firsts = F.filter("_money", lambda s, i: (i == 0) | (F.get(F.col("_money"), i - 1)["text"] != s["text"]))

    def events(label: str) -> Column:
        """Keywords and spans of a label by position, a keyword before the span that starts with it."""
        nothing = F.lit(None).cast("string")
        marks = F.transform(
            "_keywords",
            lambda w: F.struct(w["at"].alias("at"), F.lit(False).alias("is_span"), w["word"].alias("word"), nothing.alias("text")),
        )
        ends = F.transform(
            F.filter(spans, lambda s: s["label"] == label),
            lambda s: F.struct(s["at"].alias("at"), F.lit(True).alias("is_span"), nothing.alias("word"), s["text"].alias("text")),
        )
        return F.sort_array(F.concat(marks, ends))

    def near(label: str, window: int) -> Column:
        """Keywords with a span in their window: (word, gap, text) of the nearest, by position."""
        stream = F.col(f"_events_{label}")

        def hit(e: Column, i: Column) -> Column:
            nearest = first_of(F.filter(F.slice(stream, i + 2, window), lambda x: x["is_span"]))
            gap = nearest["at"] - e["at"]
            return F.when(
                ~e["is_span"] & (gap < window),
                F.struct(e["word"].alias("word"), gap.alias("gap"), nearest["text"].alias("text")),
            )

        return F.filter(F.transform(stream, hit), lambda h: h.isNotNull())

    def with_word(word: str):
        return lambda h: h["word"] == word

    def of_kind(kind: str, read) -> Column:
        """Values and confidences behind the keywords of a kind that can be read, in the order of the list."""
        hits = []
        for _, _, word, label, n in (k for k in entries if k[0] == kind):
            hits.append(
                let(
                    first_of(F.filter(f"_near_{label}_{n}", with_word(word))),
                    lambda hit, n=n: F.when(
                        hit["text"].isNotNull(),
                        F.struct(hit["text"].alias("text"), near_confidences(n)[hit["gap"]].alias("confidence")),
                    ),
                )
            )
        found = F.filter(F.array(*hits), lambda h: h.isNotNull())
        valued = F.transform(found, lambda h: F.struct(read(h["text"]).alias("value"), h["confidence"].alias("confidence")))
        return F.filter(valued, lambda h: h["value"].isNotNull())

    def best(scored: Column, value: str) -> Column:
        """Highest confidence first, the earlier span on a tie."""
        return let(
            F.array_max(F.filter(scored, lambda s: s[value].isNotNull())),
            lambda top: F.when(top.isNotNull(), F.struct(top[value].alias("value"), top["confidence"].alias("confidence"))),
        )

    evidence_row = F.struct(
        best(F.col("_org"), "text").alias("org"),
        first_of(of_kind("invoice_date", normalize_date)).alias("date_near"),
        best(F.col("_date"), "date").alias("date_best"),
        of_kind("due_date", normalize_date).alias("due_near"),
        first_of(of_kind("total_amount", normalize_amount)).alias("total_near"),
        best(F.col("_sum"), "amount").alias("money_best"),
        best(F.col("_sum"), "currency")["value"].alias("money_currency"),
        *[
            first_of(of_kind(kind, normalize_date if label == "DATE" else normalize_amount)).alias(kind)
            for kind, label in dict((k, label) for k, _, _, label, _ in extra).items()
        ],
    )
    return [
        {
            "_keywords": F.filter(words, lambda w: w.isNotNull()),
            "_orgs": texts_of(lambda s: s["label"] == "ORG"),
            "_dates": texts_of(lambda s: (s["label"] == "DATE") & ~s["text"].rlike(V.ENTITY_RELATIVE_DATE)),
            "_money": amounts,
        },
        {f"_events_{label}": events(label) for label, _ in windows},
        {f"_near_{label}_{n}": near(label, n) for label, n in windows},
        {
            "_org": F.transform(
                "_orgs",
                lambda x, i: F.struct(_org_confidence(x, F.col("_top")).alias("confidence"), (-i).alias("rank"), x.alias("text")),
            ),
            "_date": F.transform(
                "_dates",
                lambda x, i: F.struct(_date_confidence(x).alias("confidence"), (-i).alias("rank"), normalize_date(x).alias("date")),
            ),
            "_sum": F.transform(
                firsts,
                lambda s: F.struct(
                    _money_confidence(s["label"], s["text"]).alias("confidence"), (-s["no"]).alias("rank"),
                    normalize_amount(s["text"]).alias("amount"), detect_currency(s["text"]).alias("currency"),
                ),
            ),
        },
        {"evidence": evidence_row.cast(evidence_type(extra))},
    ]
