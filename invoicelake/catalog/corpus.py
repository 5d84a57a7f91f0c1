"""Document tables derived from the given tables, for the registered queries.

The given tables hold no invoices, so ``rendered_invoices`` writes one for
every order.  Labels, date and number styles and missing parts follow
mixed-radix digits of the order key, so every rule and every missing-field
case occurs and each expected value can be told from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from invoicelake.functions.columns import per_application
from invoicelake.functions.intake import header_of, tail_of
from invoicelake.sources.readers import read_text_corpus


DIGITS = {
    "num": (1, 6), "dat": (6, 8), "due": (48, 6), "amt": (288, 5), "cur": (1440, 5),
    "tot": (3, 6), "ven": (7, 4), "sub": (11, 2), "tab": (13, 2), "crlf": (17, 2), "code": (2, 3),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digit(key: Column, name: str) -> Column:
    divisor, base = DIGITS[name]
    return (F.floor(key / divisor) % base).cast("int")


def _cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _line_text() -> Column:
    """The line of an invoice for a row of lines; cells are split by a mark that the invoice's gap replaces."""
    qty, cents = F.col("qty"), F.col("cents")
    unit = F.floor((2 * cents + qty) / (2 * qty))
    name = F.concat(F.lit("Part#"), padded(F.col("l_partkey"), 6), F.lit(" "), F.col("l_returnflag"))
    return F.concat_ws("\x1f", name, qty.cast("string"), money_text(unit, F.lit(0)), money_text(cents, F.lit(0)))


def billed_orders(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """One row per invoice: the order's figures and its lines, sorted, with ``texts`` each with its text.

    The text of a line is made of its row, in compiled code, not of the element of an array; the lines are moved before.

    The lines of an order end up in one text, hence in one value.  The merge join keeps the lines where their
    grouping has put them and moves the orders there, so texts are rendered by all the tasks of that shuffle;
    with the lines broadcast they would be rendered by the few tasks that read the orders.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        F.col("l_quantity").cast("bigint").alias("qty"), _cents(F.col("l_extendedprice")).alias("cents"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", F.to_date("o_orderdate").alias("odate"),
        _cents(F.col("o_totalprice")).alias("total_cents"),
    )
    line = ["l_partkey", "l_suppkey", "l_linenumber", "qty", "cents", "l_returnflag"]
    if texts:
        # the text stands last, so that the order of the lines is the same
        lines, line = lines.repartition("l_orderkey").withColumn("line", _line_text()), [*line, "line"]
    items = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(*line))).alias("items"))
    none = F.array().cast(items.schema["items"].dataType)
    return orders.hint("merge").join(items, "k", "left").select(
        F.col("k").alias("doc_id"), "k", "o_custkey", "odate", "total_cents", F.coalesce("items", none).alias("items")
    )


def true_items(items: Column) -> Column:
    """The items of an order as an extraction should return them."""

    def item(i: Column) -> Column:
        unit = F.floor((2 * i["cents"] + i["qty"]) / (2 * i["qty"]))
        return F.struct(
            F.concat(F.lit("Part#"), padded(i["l_partkey"], 6), F.lit(" "), i["l_returnflag"]).alias("description"),
            i["qty"].cast("double").alias("quantity"), (unit / 100).alias("unit_price"), (i["cents"] / 100).alias("amount"),
        )

    return F.transform(items, item)


def _grouped(digits: Column, size: int, mark: str) -> Column:
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{%d})+$)" % size, mark)


def money_text(cents: Column, style: Column) -> Column:
    """0 plain, 1 US, 2 European, 3 Indian, 4 spaces."""
    whole = F.floor(cents / 100).cast("string")
    part = F.lpad((cents % 100).cast("string"), 2, "0")
    head, tail = F.left(whole, F.length(whole) - 3), F.right(whole, F.lit(3))
    indian = F.when(F.length(whole) > 3, F.concat(_grouped(head, 2, ","), F.lit(","), tail)).otherwise(whole)
    return (
        F.when(style == 1, F.concat(_grouped(whole, 3, ","), F.lit("."), part))
        .when(style == 2, F.concat(_grouped(whole, 3, "."), F.lit(","), part))
        .when(style == 3, F.concat(indian, F.lit("."), part))
        .when(style == 4, F.concat(_grouped(whole, 3, " "), F.lit("."), part))
        .otherwise(F.concat(whole, F.lit("."), part))
    )


def _pick(value: Column, *choices: Column | None) -> Column:
    """The choice at the position ``value``; None stands for a missing line."""
    result = F.lit(None).cast("string")
    for at, choice in enumerate(choices):
        if choice is not None:
            result = F.when(value == at, choice).otherwise(result)
    return result


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def padded(key: Column, width: int) -> Column:
    """Leading zeros up to the width; longer keys stay whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


@per_application
def _invoice_text() -> Column:
    k, items = F.col("k"), F.col("items")
    d = {name: digit(k, name) for name in DIGITS}

    number = F.concat(F.lit("INV-"), padded(k, 6))
    supplier = F.concat(F.lit("Supplier#"), padded(F.array_min(items["l_suppkey"]), 9))
    base = F.when(F.size(items) > 0, supplier).otherwise("Unbilled Trading")
    full = F.concat(base, F.lit(" Ltd"))
    vendor_line = _pick(
        d["ven"], full, _labelled("From: ", full), _labelled("Company Name: ", full), base
    )
    number_line = _pick(
        d["num"], _labelled("Invoice No: ", number), _labelled("Bill No: ", number),
        _labelled("Receipt No: ", number), _labelled("Ref: ", number), number, None,
    )

    def dated(days: int, style: str) -> Column:
        return F.date_format(F.date_add("odate", days), style)

    date_line = _pick(
        d["dat"],
        _labelled("Invoice Date: ", dated(0, "dd/MM/yyyy")),
        _labelled("Issued on: ", dated(0, "d-M-yyyy")),
        _labelled("Dated ", dated(0, "dd.MM.yyyy")),
        _labelled("Invoice Date: ", dated(0, "yyyy-MM-dd")),
        _labelled("Invoice Date: ", dated(0, "d MMMM yyyy")),
        _labelled("Date: ", dated(0, "MMMM d, yyyy")),
        _labelled("Date: ", dated(0, "yyyy-MM-dd")),
        None,
    )
    due_line = _pick(
        d["due"],
        _labelled("Due Date: ", dated(30, "dd/MM/yyyy")),
        _labelled("Pay by: ", dated(45, "d MMMM yyyy")),
        F.lit("Net 60"),
        _labelled("Due Date: ", dated(30, "yyyy-MM-dd")),
        None,
        _labelled("Due Date: ", dated(-10, "dd/MM/yyyy")),
    )
    gap = F.when(d["tab"] == 1, "\t").otherwise("   ")

    body = F.concat(
        F.lit("Description\x1fQty\x1fUnit Price\x1fAmount\n"), F.array_join(items["line"], "\n")
    )
    item_block = F.when(F.size(items) > 0, F.replace(body, F.lit("\x1f"), gap))
    sub_cents = F.aggregate(items, F.lit(0).cast("bigint"), lambda t, i: t + i["cents"])
    sub_line = F.when(
        (d["sub"] == 1) & (F.size(items) > 0), _labelled("Subtotal: ", money_text(sub_cents, F.lit(0)))
    )
    code = _pick(d["code"], F.lit("USD "), F.lit("GBP "), F.lit("CHF "))
    sign = _pick(d["cur"], code, F.lit("$"), F.lit("€"), F.lit("₹"), F.lit(""))
    label = _pick(
        d["tot"], *map(F.lit, ("Grand Total", "Total Amount Due", "Amount Due", "Balance Due", "Amount Payable", "Total"))
    )
    total_line = F.concat(label, F.lit(": "), sign, money_text(F.col("total_cents"), d["amt"]))
    text = F.concat_ws(
        "\n",
        vendor_line,
        number_line,
        date_line,
        due_line,
        _labelled("Bill To: Customer#", padded(F.col("o_custkey"), 9)),
        F.lit(""),
        item_block,
        F.lit(""),
        sub_line,
        total_line,
    )
    raw = F.when(d["crlf"] == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return raw


def rendered_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table docs(doc_id, raw_text): one text per invoice."""
    return billed_orders(spark, sf_dir, texts=True).select("doc_id", _invoice_text().alias("raw_text"))


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered invoices, every fourth of them with the closing lines of a purchase order."""
    k = F.col("doc_id")
    style = F.floor(k / 4) % 2
    day = F.date_add("odate", 7)
    delivery = F.when(style == 0, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    closing = F.concat(F.lit("\nPO Number: PO-"), padded(k, 6), F.lit("\nDelivery Date: "), delivery)
    return billed_orders(spark, sf_dir, texts=True).select(
        "doc_id", F.concat(_invoice_text(), F.when(k % 4 == 1, closing).otherwise("")).alias("raw_text")
    )


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents as docs(doc_id, raw_text)."""
    return read_text_corpus(spark, f"{sf_dir}/documents.parquet")


def messy_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents with CRLF, tabs, runs of blanks and empty lines put in."""
    text = F.col("raw_text")
    for old, new in ((". ", ".\r\n"), (", ", ",\t "), ("\n", "\n\n\n\n"), (" de ", "   de ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return prose(spark, sf_dir).select("doc_id", F.concat(F.lit(" \t"), text, F.lit("\n ")).alias("raw_text"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as pages; every third one scanned, every seventh blank."""
    turns = table(spark, sf_dir, "conversations")
    pick = (F.col("conv_id") + F.col("turn")) % 7
    scanned = (F.col("conv_id") + F.col("turn")) % 3 == 0
    text = F.coalesce("text", F.lit(""))
    return turns.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("page_no"),
        F.when(scanned, F.lit(" \n")).otherwise(F.concat(F.lit("  "), text, F.lit("\n"))).alias("native_text"),
        F.when(pick == 0, F.lit("")).otherwise(F.concat(text, F.lit(" "))).alias("ocr_text"),
    )


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as paragraphs, roles and texts once more as table cells."""
    turns = table(spark, sf_dir, "conversations")
    key, turn = F.col("conv_id"), F.col("turn").cast("int")
    text = F.coalesce("text", F.lit(""))
    blank = (key + turn) % 5 == 0
    paragraphs = turns.select(
        key.alias("doc_id"), F.lit("para").alias("block_kind"), turn.alias("block_no"),
        F.lit(None).cast("int").alias("table_no"), F.lit(None).cast("int").alias("row_no"),
        F.lit(None).cast("int").alias("cell_no"), F.when(blank, F.lit("  ")).otherwise(text).alias("text"),
    )
    cells = turns.filter(key % 2 == 0).select(
        key.alias("doc_id"), F.lit("cell").alias("block_kind"), F.lit(None).cast("int").alias("block_no"),
        F.floor(turn / 2).cast("int").alias("table_no"), (turn % 2).cast("int").alias("row_no"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("cell_no"), F.when(blank, F.lit("")).otherwise(F.col("role")).alias("text")),
                F.struct(F.lit(1).alias("cell_no"), F.when(blank, F.lit(" ")).otherwise(text).alias("text")),
                F.struct(F.lit(2).alias("cell_no"), turn.cast("string").alias("text")),
            )
        ).alias("c"),
    ).select("doc_id", "block_kind", "block_no", "table_no", "row_no", "c.cell_no", "c.text")
    return paragraphs.unionByName(cells)


def _files(frame: DataFrame, key: Column, length: Column) -> DataFrame:
    """Uploads with every kind of header, name and decoding result, by key."""
    kinds = [
        ("25504446", "scan.pdf"), ("FFD8FFE0", "photo.JPG"), ("89504E47", "page.png"), ("49492A00", "fax.tiff"),
        ("504B0304", "letter.docx"), ("504B0304", "bundle.zip"), ("4D5A9000", "setup.pdf"), ("00010203", "memo.DOCX"),
        ("00010203", "noise.bin"), ("", ""), ("524946460000000057454250", "shot.webp"),
    ]
    at = (key % len(kinds)).cast("int")
    header = _pick(at, *[F.lit(h) for h, _ in kinds])
    name = _pick(at, *[F.lit(n) for _, n in kinds])
    decode = F.when(F.floor(key / 11) % 9 == 0, "encrypted").when(F.floor(key / 11) % 9 == 1, "failed")
    folder = F.concat(F.lit("/in/"), key.cast("string"), F.lit("/"))
    return frame.select(
        key.alias("doc_id"),
        F.concat(folder, name).alias("path"),
        length.alias("length"),
        F.unhex(header).alias("header"),
        F.when((decode == "encrypted") & (at != 0), F.lit(None)).otherwise(decode).alias("decode_status"),
        F.when(decode == "failed", F.concat(F.lit("bad part "), key.cast("string"))).alias("decode_error"),
        (key % 22 == 0).alias("password_given"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per given document; long documents exceed the size limit."""
    docs = table(spark, sf_dir, "documents")
    return _files(docs, F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("bigint") * 2000)


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per conversation."""
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size")
    )
    return _files(convs, F.col("conv_id"), F.col("size").cast("bigint") * 5000)


def invoice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per rendered invoice, of every kind and outcome."""
    return _files(table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit(50_000).cast("bigint"))


def invoice_pages(docs: DataFrame) -> DataFrame:
    """Each text as one page; of every third document it was scanned."""
    scanned = F.col("doc_id") % 3 == 0
    return docs.select(
        "doc_id", F.lit(1).alias("page_no"), F.when(~scanned, F.col("raw_text")).alias("native_text"),
        F.when(scanned, F.col("raw_text")).alias("ocr_text"),
    )


def invoice_blocks(docs: DataFrame) -> DataFrame:
    """Each line of a text as one paragraph."""
    unix = F.replace(F.col("raw_text"), F.lit("\r\n"), F.lit("\n"))
    none = F.lit(None).cast("int")
    return docs.select("doc_id", F.posexplode(F.split(unix, "\n")).alias("block_no", "text")).select(
        "doc_id", F.lit("para").alias("block_kind"), "block_no", none.alias("table_no"), none.alias("row_no"),
        none.alias("cell_no"), "text",
    )


def _le(value: Column | int, size: int) -> Column:
    """A number as bytes, the lowest first."""
    whole = F.lpad(F.hex(F.lit(value).cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(whole, 2 * (size - k) - 1, 2) for k in range(size)]))


def _zip_directory(names: list[Column]) -> Column:
    """The directory of a ZIP with these entries, and its end record."""
    zeros = lambda n: F.unhex(F.lit("00" * n))
    entries = [
        F.concat(F.unhex(F.lit("504B0102")), zeros(24), _le(F.octet_length(n), 2), zeros(16), n.cast("binary")) for n in names
    ]
    directory = F.concat(*entries)
    end = F.concat(
        F.unhex(F.lit("504B0506")), zeros(4), _le(len(names), 2), _le(len(names), 2), _le(F.octet_length(directory), 4), zeros(6)
    )
    return F.concat(directory, end)


def zipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ZIP per given document, by key: as it is named, without a name for it, under a wrong name, or cut off."""
    key = F.col("doc_id")
    body = F.concat(F.unhex(F.lit("504B0304")), F.coalesce("text", F.lit("")).cast("binary"))
    at = (key % 6).cast("int")
    word = [F.lit("[Content_Types].xml"), F.concat(F.lit("word/media/"), key.cast("string")), F.lit("word/document.xml")]
    sheet = [F.lit("[Content_Types].xml"), F.lit("xl/workbook.xml")]
    other = [F.concat(F.lit("notes/"), key.cast("string"), F.lit(".txt"))]
    names = ("letter.docx", "upload", "book.docx", "notes.zip", "torn.docx", "torn.zip")
    content = (
        F.when(at <= 1, F.concat(body, _zip_directory(word)))
        .when(at == 2, F.concat(body, _zip_directory(sheet)))
        .when(at == 3, F.concat(body, _zip_directory(other)))
        .otherwise(body)
    )
    return table(spark, sf_dir, "documents").select(
        key, F.concat(F.lit("/in/"), key.cast("string"), F.lit("/"), _pick(at, *map(F.lit, names))).alias("path"),
        content.alias("content"),
    ).select(
        "doc_id", "path", F.octet_length("content").cast("bigint").alias("length"), header_of(F.col("content")).alias("header"),
        tail_of(F.col("content")).alias("tail"),
    )
