"""Sources that arrive as text: columnar JSON, matrices, listings, submissions, pages, and line-level screens. Whole texts, column expressions only."""
import html.entities
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def read_bundle(spark: SparkSession, path: str, schema: str, lines=False) -> dict:
    """S1. JSON documents of row lists to one DataFrame per list; `schema` is the struct of lists.

    A file is one document, read by one task; with `lines` every line is one, holding some rows of some lists, and files of any size are read in splits.
    """
    doc = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    lists = [f.name for f in doc.schema.fields if f.dataType.typeName() == "array"]
    return {name: doc.select(F.inline(name)) for name in lists}


def zip_columns(df: DataFrame, required, optional=()) -> DataFrame:
    """S2. A struct of parallel arrays to rows. A row whose required arrays differ in length is refused with a reason; a missing optional array gives nulls."""
    keep = [c for c in df.columns if c not in (*required, *optional)]
    n = F.size(required[0])
    same = F.lit(True)
    for c in required[1:]:
        same = same & (F.size(c) == n)
    for c in optional:
        same = same & (F.col(c).isNull() | (F.size(c) == n))
    d = df.withColumn("_bad", ~F.coalesce(same, F.lit(False)))
    cols = [F.col(c) for c in required] + [F.coalesce(F.col(c), F.array_repeat(F.lit(None).cast("string"), n)).alias(c) for c in optional]
    good = d.filter(~F.col("_bad")).select(*keep, F.inline(F.arrays_zip(*cols)))
    return good, d.filter("_bad").select(*keep, F.lit("COLUMN_LENGTHS_DIFFER").alias("reason"))


def matrix_rows(df: DataFrame, fields, names="fields", data="data", keep=()) -> DataFrame:
    """S3. {fields, data} to rows: each wanted field is taken at its own position; a row of another length is refused (null)."""
    d = df.select(*keep, names, F.explode(data).alias("_row"))
    ok = F.size("_row") == F.size(names)
    return d.select(*keep, *[F.when(ok, F.get("_row", F.array_position(F.col(names), f).cast("int") - 1)).alias(f) for f in fields], (~ok).alias("refused"))


FOOTER = "File Creation Time:"


def read_listing(spark: SparkSession, path: str, columns, key=None, on_bad="raise"):
    """S4. Pipe-delimited listing files: in each file a header line, rows, and exactly one creation-time footer, else the file is refused by name.

    Columns are taken by the names of the file's own header, in any order. A row without its key column (by default the first of `columns`), or with one that occurs again in any file, keeps
    its values and says so in `reason`. Only the first line of a file is a header and only a line without any further field is a footer, whatever rows are called. Files are read
    in splits; what is known per file is one row. A refused file raises an error with its name and reason, or (`on_bad="refuse"`) is left out, and (rows, refused files) are returned. Empty files hold nothing.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")).filter("value <> ''")
    key, fields = key or columns[0], F.split("value", r"\|", -1)
    heads = lines.filter("_start = 0").groupBy("_file").agg(F.min_by("value", "_at").alias("_head"), F.min("_at").alias("_first"))
    place = lambda c: F.array_position("_names", c).cast("int")
    # split lines know their file's header by its name; a table of one row per file
    body = lines.join(heads.withColumn("_names", F.split("_head", r"\|", -1)), "_file").filter("not (_start = 0 and _at = _first)").withColumn("_f", fields)
    footer = F.startswith("value", F.lit(FOOTER)) & F.forall(F.slice("_f", F.lit(2), F.greatest(F.size("_f") - 1, F.lit(0))), lambda x: F.trim(x) == "")
    body = body.withColumn("_footer", footer)
    lacking = F.filter(F.array(*[F.lit(c) for c in columns]), lambda c: ~F.array_contains("_names", c))
    count = body.groupBy("_file").agg(F.count_if("_footer").alias("_n"))
    state = heads.withColumn("_names", F.split("_head", r"\|", -1)).join(count, "_file", "left").select("_file", F.when(F.size(lacking) > 0, F.concat(F.lit("lacks the columns "), F.array_join(lacking, ", ")))
                                                                                                     .when(F.coalesce("_n", F.lit(0)) != 1, F.concat(F.lit("has "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" footers"))).alias("reason"))
    bad = state.filter("reason is not null")
    if on_bad == "raise":
        if found := bad.take(5):
            raise ValueError("; ".join(f"listing {r['_file']} {r['reason']}" for r in found))
        good = body
    else:
        good = body.join(bad.select("_file"), "_file", "left_anti")
    good = good.filter("not _footer").select(*[F.nullif(F.get("_f", place(c) - 1), F.lit("")).alias(c) for c in columns])
    again = good.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_k"), F.lit(True).alias("_again"))
    reason = F.when(F.coalesce(F.trim(F.col(key)), F.lit("")) == "", "MISSING_SYMBOL").when(F.col("_again"), "DUPLICATE_SYMBOL")
    rows = good.join(again, F.col(key) == F.col("_k"), "left").select(*columns, reason.alias("reason"))
    return rows if on_bad == "raise" else (rows, bad.select(F.col("_file").alias("file"), "reason"))


# Fixed value: shape of a security identifier.
ISIN = r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"


def extract_positions(df: DataFrame, text: str, marker: str, fields: dict, keep=(), header_end: str = None, whole=()) -> DataFrame:
    """S5. Cut a filing at a section marker and take labelled fields of each section; a field must occur exactly once, else it is null.

    With `header_end`, fields are looked for in what stands before it; those named in `whole` in the whole section.
    """
    parts = F.split(F.col(text), F.regexp_replace(F.lit(marker), r"([.\\(\\)])", r"\\$1"))
    s = df.select(*keep, F.posexplode(parts).alias("_n", "_s")).filter("_n > 0")
    s = s.withColumn("_h", F.substring_index("_s", header_end, 1) if header_end else F.col("_s"))

    def field(name, label):
        found = F.regexp_extract_all("_s" if name in whole else "_h", F.lit(r"(?m)^" + label.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") + r"[^\S\n]*\n([^\n]+)"), F.lit(1))
        return F.when(F.size(found) == 1, F.trim(F.element_at(found, 1)))

    return s.select(*keep, F.col("_n").alias("position"), *[field(name, label).alias(name) for name, label in fields.items()])


def check_positions(filings: DataFrame, positions: DataFrame, by, identifier="isin", required=("name", "title", "isin", "country")):
    """S5. (positions with `reason`, filings with their number of positions, faults and `reason`).

    A position lacks a required field, its identifier has another shape, or the filing names the identifier more than once. A filing is refused (its reason is set) if it has
    no position or a faulty one; `by` is the key of a filing.
    """
    by = [by] if isinstance(by, str) else list(by)
    often = positions.filter(F.col(identifier).isNotNull()).groupBy(*by, identifier).agg((F.count(F.lit(1)) > 1).alias("_often"))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in required]))
    reason = (F.when(F.size(lacking) > 0, F.concat(F.lit("MISSING_FIELD:"), F.array_join(lacking, ","))).when(~F.rlike(identifier, F.lit(ISIN)), "INVALID_IDENTIFIER")
              .when(F.col("_often"), "DUPLICATE_IDENTIFIER"))
    checked = positions.join(often, [*by, identifier], "left").withColumn("reason", reason).drop("_often")
    per = checked.groupBy(*by).agg(F.count(F.lit(1)).alias("positions"), F.count("reason").alias("faults"))
    state = F.when(F.col("positions") == 0, "NO_POSITIONS").when(F.col("faults") > 0, "FAULTY_POSITIONS")
    return checked, filings.select(*by).distinct().join(per, by, "left").fillna({"positions": 0, "faults": 0}).withColumn("reason", state)


def issuer_roster(checked: DataFrame, by, identifier="isin", name="name", fields=("title", "country")) -> DataFrame:
    """S5. Issuers of each filing with their securities in order of the identifier; an issuer's securities in one filing are few."""
    by = [by] if isinstance(by, str) else list(by)
    return checked.groupBy(*by, name).agg(F.array_sort(F.collect_list(F.struct(identifier, *fields))).alias("securities"))


def extract_exhibits(df: DataFrame, text: str, keep=()) -> DataFrame:
    """S6. Submission text to its EX-99 exhibits: type, file name and body; each row carries how many documents the header lists and how many are there."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<DOCUMENT>\s*(.*?)</DOCUMENT>"), F.lit(1))
    listed = F.regexp_extract(F.col(text), r"(?im)^PUBLIC DOCUMENT COUNT:\s*(\d+)", 1)
    d = df.select(*keep, F.when(listed != "", listed.cast("int")).alias("listed"), F.size(blocks).alias("available"), F.explode(blocks).alias("_b"))
    kind = F.trim(F.regexp_extract("_b", r"(?im)^<TYPE>([^\r\n<]+)", 1))
    return (d.withColumn("form_type", kind).filter(F.rlike("form_type", F.lit(r"^EX-99(\.\d+)?$")))
            .withColumn("filename", F.trim(F.regexp_extract("_b", r"(?im)^<FILENAME>([^\r\n<]+)", 1))).withColumn("body", F.regexp_extract("_b", r"(?is)<TEXT>(.*)</TEXT>", 1)).drop("_b"))


def read_submissions(df: DataFrame, text: str, accession: str, cik: str, keep=()) -> tuple[DataFrame, DataFrame]:
    """S6. (exhibits, refused): the exhibits of submissions that are whole and say who they are; the others once each, with the first reason that holds.

    IDENTITY_MISMATCH: the header lacks its end, the asked accession number or the asked ten-digit identifier. INCOMPLETE_SUBMISSION: no document count, a document that does not end, or no
    closing tag at the end. INCOMPLETE_EXHIBIT: an exhibit without file name or text. INVALID_FILENAME: a name that could leave its folder.
    """
    t = F.col(text)
    head = F.regexp_extract(t, r"(?s)^(.*?)</SEC-HEADER>", 1)
    blocks = F.regexp_extract_all(t, F.lit(r"(?is)<DOCUMENT>\s*(.*?)</DOCUMENT>"), F.lit(1))
    d = df.select(*keep, t.alias("_t"), head.alias("_h"), F.col(accession).alias("_a"), F.col(cik).alias("_c"), blocks.alias("_b"), F.regexp_extract(head, r"(?im)^PUBLIC DOCUMENT COUNT:\s*(\d+)", 1).alias("_n"))
    kind = lambda b: F.trim(F.regexp_extract(b, r"(?im)^<TYPE>([^\r\n<]+)", 1))
    name = lambda b: F.trim(F.regexp_extract(F.regexp_extract(b, r"(?is)^(.*?)(?:<TEXT>|$)", 1), r"(?im)^<FILENAME>([^\r\n<]+)", 1))
    body = lambda b: F.regexp_extract(b, r"(?is)<TEXT>(.*)</TEXT>", 1)
    exhibits = F.filter("_b", lambda b: F.rlike(kind(b), F.lit(r"^EX-99(\.\d+)?$")))
    identity = F.contains("_t", F.lit("</SEC-HEADER>")) & F.array_contains(F.regexp_extract_all("_h", F.lit(r"(?im)^ACCESSION NUMBER:[ \t]*(\S+)[ \t]*$"), F.lit(1)), F.col("_a")) & F.array_contains(F.regexp_extract_all("_h", F.lit(r"(?im)CENTRAL INDEX KEY:\s*(\d{10})"), F.lit(1)), F.col("_c"))
    whole = (F.col("_n") != "") & (F.size("_b") == F.regexp_count("_t", F.lit("<DOCUMENT>"))) & F.rlike("_t", F.lit(r"</SEC-DOCUMENT>\s*$"))
    reason = (F.when(~F.coalesce(identity, F.lit(False)), "IDENTITY_MISMATCH").when(~F.coalesce(whole, F.lit(False)), "INCOMPLETE_SUBMISSION")
              .when(F.exists("_x", lambda b: (name(b) == "") | ~F.rlike(b, F.lit(r"(?is)<TEXT>.*</TEXT>"))), "INCOMPLETE_EXHIBIT").when(F.exists("_x", lambda b: ~F.rlike(name(b), F.lit(r"^[A-Za-z0-9_.-]+$"))), "INVALID_FILENAME"))
    d = d.withColumn("_x", exhibits).withColumn("reason", reason)
    made = F.transform("_x", lambda b: F.struct(kind(b).alias("form_type"), name(b).alias("filename"), body(b).alias("body")))
    found = d.filter("reason is null").select(*keep, F.col("_n").cast("int").alias("listed"), F.size("_b").alias("available"), F.inline(made))
    return found, d.filter("reason is not null").select(*keep, "reason")


def unescape(c: Column) -> Column:
    """Character references to characters: every named one that ends in a semicolon, and numeric ones (128 to 159 as in windows-1252, numbers of no character as U+FFFD).

    The text is split before each ampersand; names come from the standard table of HTML5, as one constant map.
    """
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})), "map<string,string>")
    western = F.from_json(F.lit(json.dumps({str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)})), "map<string,string>")

    def piece(x):
        ref = F.regexp_extract(x, r"^&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        number = F.when(F.rlike(ref, F.lit("^#[xX]")), F.conv(F.substring(ref, F.lit(3), F.lit(9)), 16, 10)).otherwise(F.substring(ref, F.lit(2), F.lit(9))).try_cast("bigint")
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        numeric = F.when(number.between(128, 159), F.element_at(western, number.cast("string"))).when(real, F.decode(F.unhex(F.lpad(F.hex(F.when(real, number).otherwise(65)), 8, "0")), "UTF-32")).otherwise("\ufffd")
        char = F.when(F.startswith(ref, F.lit("#")), numeric).when(ref != "", F.try_element_at(names, ref))
        return F.coalesce(F.concat(char, F.substring(x, F.length(ref) + 3, F.length(x))), x)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")).otherwise(c)


def html_text(col) -> Column:
    """S7. HTML to text with line ends at block ends: script and style dropped, table cells set off by a bar."""
    c = F.col(col) if isinstance(col, str) else col
    for pattern, to in ((r"(?is)<(script|style|ix:hidden)\b[^>]*>.*?</\1\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<(br|li)\b[^>]*>", "\n"), (r"(?i)<(td|th)\b[^>]*>", " | "),
                        (r"(?i)</(tr|p|li|div|h1|h2|h3|h4)\s*>", "\n"), (r"(?s)<[^>]*>", "")):
        c = F.regexp_replace(c, pattern, to)
    return unescape(c)


def html_lines(pages: DataFrame, html: str = "html", keep=()) -> DataFrame:
    """S7. One row per non-empty text line of a page, numbered in order, blanks squeezed and outer bars trimmed."""
    squeezed = F.transform(F.split(html_text(html), r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" |")))
    return pages.select(*keep, F.posexplode(F.filter(squeezed, lambda x: x != "")).alias("line_no", "line"))


def tag_values(pages: DataFrame, pattern: str, html: str = "html", keep=()) -> DataFrame:
    """S8. (context, name, value) of tagged facts; `pattern` has the three groups in that order."""
    hits = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    part = lambda i: F.regexp_extract("_h", pattern, i)
    return pages.select(*keep, F.explode(hits).alias("_h")).select(*keep, part(1).alias("context"), F.lower(part(2)).alias("name"), F.trim(F.regexp_replace(part(3), r"\s+", " ")).alias("value"))


def inline_facts(pages: DataFrame, html: str = "html", keep=()) -> DataFrame:
    """S8. (context, name, value) of every `ix:nonNumeric` fact with a name and a context, names without their prefix and in lower case.

    Markup is cut into tags and text; a fold over the fact and continuation tags with a stack pairs each opening tag with its own end, so facts may hold facts, and a fact's value is all text
    between its tags. Text goes on in `ix:continuation` elements, chained by `continuedAt`. An element that never ends is not read; an end without a beginning is passed over.
    """
    tokens = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<"), F.lit(0))
    d = pages.select(*keep, tokens.alias("_t"))
    numbered = F.transform("_t", lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.lower(F.regexp_extract(t, r"(?is)^<(/?)ix:(nonnumeric|continuation)\b", 2)).alias("kind"), F.startswith(t, F.lit("</")).alias("ends"), F.rlike(t, F.lit(r"/\s*>$")).alias("empty")))
    d = d.withColumn("_x", F.filter(numbered, lambda x: (x["kind"] != "") & ~x["empty"]))
    stack = "struct<stack:array<struct<i:int,kind:string>>,pairs:array<struct<a:int,b:int,kind:string>>>"

    def step(acc, x):
        top = F.get(acc["stack"], F.lit(0))
        push = F.struct(F.concat(F.array(F.struct(x["i"].alias("i"), x["kind"].alias("kind"))), acc["stack"]).alias("stack"), acc["pairs"].alias("pairs"))
        pop = F.struct(F.slice(acc["stack"], F.lit(2), F.greatest(F.size(acc["stack"]), F.lit(1))).alias("stack"), F.concat(acc["pairs"], F.array(F.struct(top["i"].alias("a"), x["i"].alias("b"), x["kind"].alias("kind")))).alias("pairs"))
        return F.when(~x["ends"], push.cast(stack)).when(top["kind"] == x["kind"], pop.cast(stack)).otherwise(acc)

    empty = F.from_json(F.lit('{"stack": [], "pairs": []}'), stack)
    d = d.withColumn("_p", F.aggregate("_x", empty, step)["pairs"])
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    inside = lambda p: F.array_join(F.filter(F.slice("_t", p["a"] + 2, p["b"] - p["a"] - 1), lambda t: ~F.rlike(t, F.lit("(?s)^<."))), "")
    tag = lambda p: F.get("_t", p["a"])
    parts = F.transform("_p", lambda p: F.struct(p["kind"].alias("kind"), attribute(tag(p), "id").alias("id"), attribute(tag(p), "continuedAt").alias("next"), attribute(tag(p), "contextRef").alias("context"),
                                                 F.element_at(F.split(F.lower(attribute(tag(p), "name")), ":"), -1).alias("name"), inside(p).alias("text")))
    d = d.select(*keep, parts.alias("_q"))
    more = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.filter("_q", lambda q: (q["kind"] == "continuation") & (q["id"] != "")), lambda q: q["id"])),
                                          lambda k: F.struct(k.alias("id"), F.get(F.filter("_q", lambda q: (q["kind"] == "continuation") & (q["id"] == k)), F.lit(0)).alias("q"))))
    d = d.withColumn("_more", more).withColumn("_f", F.explode(F.filter("_q", lambda q: (q["kind"] == "nonnumeric") & (q["name"] != "") & (q["context"] != ""))))
    chain = "struct<text:string,next:string>"
    follow = lambda acc, _: F.when(F.map_contains_key("_more", acc["next"]), F.struct(F.concat(acc["text"], F.try_element_at("_more", acc["next"])["text"]).alias("text"), F.try_element_at("_more", acc["next"])["next"].alias("next")).cast(chain)).otherwise(acc)
    whole = F.aggregate(F.sequence(F.lit(0), F.size("_more")), F.struct(F.col("_f.text").alias("text"), F.col("_f.next").alias("next")).cast(chain), follow)["text"]
    return d.select(*keep, F.col("_f.context").alias("context"), F.col("_f.name").alias("name"), F.trim(F.regexp_replace(unescape(whole), r"(?U)\s+", " ")).alias("value"))


def pivot_tag_contexts(tags: DataFrame, names, keep=()) -> DataFrame:
    """S8. Contexts that carry every wanted name with exactly one value each. Distinct values are counted, not gathered."""
    one = [F.count_distinct(F.when(F.col("name") == n, F.col("value"))).alias("_n_" + n) for n in names]
    val = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    g = tags.groupBy(*keep, "context").agg(*one, *val)
    for n in names:
        g = g.filter(F.col("_n_" + n) == 1)
    return g.drop(*["_n_" + n for n in names])


def bars_from_pages(pages: DataFrame, symbol="symbol", bars="bars") -> DataFrame:
    """S9. Provider pages to bars; a session that came more than once, or a foreign symbol, is marked. Counting is a grouping, not a window over a symbol."""
    b = pages.select(F.col(symbol).alias("asked"), F.explode(bars).alias("_b")).select("asked", "_b.*")
    n = b.groupBy("asked", "session").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("symbol", "open", "high", "low", "close", "volume")).alias("_r"))
    reason = F.when(F.col("_n") > 1, "DUPLICATE_SESSION").when(F.col("_r.symbol") != F.col("asked"), "FOREIGN_SYMBOL")
    return n.select("asked", "session", "_r.open", "_r.high", "_r.low", "_r.close", "_r.volume", reason.alias("reason"))


# Which date of an action counts, in order.
ACTION_DATES = ("ex_date", "effective_date", "payable_date", "process_date")


def actions_from_pages(pages: DataFrame, actions="actions", keep=()) -> DataFrame:
    """S10. A map of type to list of actions, to rows; the date is the first present of the four, and which it was is kept."""
    a = pages.select(*keep, F.explode(actions).alias("type", "_l")).select(*keep, "type", F.inline("_l"))
    field = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ACTION_DATES])
    return a.withColumn("date_field", field).withColumn("date", F.coalesce(*ACTION_DATES).cast("date"))


def read_archive(meta: DataFrame, payloads: DataFrame) -> DataFrame:
    """S11. Archived observations joined to their payloads: hash and size must agree; one row per content hash, the earliest retrieval."""
    j = meta.join(payloads, "payload_file", "left")
    state = (F.when(F.col("payload").isNull(), "PAYLOAD_MISSING").when(F.sha2("payload", 256) != F.col("sha256"), "HASH_MISMATCH")
             .when(F.octet_length("payload") != F.col("size"), "SIZE_MISMATCH").otherwise("VERIFIED"))
    return j.withColumn("state", state).groupBy("sha256", "state").agg(F.min("retrieved_at").alias("first_retrieved"), F.count(F.lit(1)).alias("observations"))


def read_payload_files(spark: SparkSession, folder: str) -> DataFrame:
    """Payload files as rows, for `read_archive`."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("payload_file"), F.col("content").alias("payload"))


def line_context(lines: DataFrame, by, before=6, after=2, order="line_no", text="line", near=None) -> DataFrame:
    """W20. The lines before and after each line of a document; with `near` also an array `excerpt` of so many lines on both sides and the line itself.

    A document may hold any number of lines, so no window spans it: lines lie in blocks, each block also receives copies of the few neighbours it needs, and a window
    covers one block.
    """
    by = list(by)
    size = 4096
    b = F.floor(F.col(order) / size)
    copies = F.array_distinct(F.array(b, F.floor((F.col(order) + before) / size), F.floor((F.col(order) - after) / size)))
    spread = lines.withColumn("_home", b).withColumn("_b", F.explode(copies))
    w = W.partitionBy(*by, "_b").orderBy(order)
    out = (spread.withColumn("before", F.array_join(F.collect_list(text).over(w.rowsBetween(-before, -1)), " "))
           .withColumn("after", F.array_join(F.collect_list(text).over(w.rowsBetween(0, after)), " ")))
    if near is not None:
        if near > min(before, after):
            raise ValueError("near reaches further than before and after")
        out = out.withColumn("excerpt", F.collect_list(text).over(w.rowsBetween(-near, near)))
    return out.filter("_b = _home").drop("_b", "_home")


# Words that mark an outlook passage.
ANCHOR = r"(?i)\b(guidance|outlook|business outlook|financial outlook|forecast|expects?|anticipates?|projects?|reaffirms?)\b"
REVENUE = r"(?i)\b(revenues?|net sales)\b"
HORIZON = r"(?i)\b(?:full.{0,3}year|fiscal year|entire year|annual|FY\s*20\d{2}|FY\s*\d{2}|20\d{2})\b"


def outlook_excerpts(lines: DataFrame, by, keep=14, revenue=REVENUE, anchor=ANCHOR, horizon=HORIZON, figure=r"\d") -> DataFrame:
    """O6. Up to `keep` candidate lines per document by score, then line, each with its `excerpt` of two lines before and after: a revenue line near an outlook word with a figure nearby. A missing hit excludes nobody."""
    c = line_context(lines, by, near=2)
    around = F.concat_ws(" ", "before", "after")
    hit = F.rlike("line", F.lit(revenue)) & F.rlike(around, F.lit(anchor)) & (F.rlike("line", F.lit(figure)) | F.contains("after", F.lit("$")))
    score = 2 * F.rlike(around, F.lit(horizon)).cast("int") + F.contains("after", F.lit("$")).cast("int") + F.rlike("line", F.lit(anchor)).cast("int")
    ranked = c.filter(hit).withColumn("score", score)
    w = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("line_no"))
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
