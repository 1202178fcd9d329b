"""One consistent form for texts that look the same but are made of other characters.

DuckDB runs inside each Arrow partition and folds a batch of texts with one embedded SQL expression. A text
of ASCII characters only is in that form already. Of any other

1. characters that take up no room are removed (regular expression),
2. nfc_normalize composes accents,
3. translate maps full- and half-width forms to the usual ones, letters in another type face to plain ones,
   blanks that allow no break to a blank, and letters of other scripts to the Latin letter of the same
   shape, alone or with composed accents; ligatures, Roman numerals and the like become the characters
   they show (a look-up by character, only in texts that have any),
4. nfc_normalize composes what the mapping brought together.

Letter case, accents, digits, punctuation, the number of blanks, tabs and line ends stay as they are. So do
forms that a reader can tell apart: superscripts, fractions, circled and squared characters, blanks of
another width, and letters of other scripts that are only similar (alpha and a, rho and p).
Only digests of the folded and of the original text leave the task, so the shuffle does not carry texts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.plans.scale import cut, join_small

#: Letters of other scripts and the Latin letters of the same shape.
CYRILLIC = ("аеорсухѕіјһӏԁԛԝѵүАВЕКМНОРСТХЅІЈӀѴҮԌԚԜ", "aeopcyxsijhldqwvyABEKMHOPCTXSIJIVYGQW")
GREEK = ("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovcjABEZHIKMNOPTYXCJ")
ARMENIAN = ("օոսհցզյՕՏՍԼ", "onuhgqjOSUL")
CHEROKEE = ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB")
COPTIC = ("ⲞⲟⲢⲣⲤⲥⲦⲨⲬⲎⲒⲔⲘⲚ", "OoPpCcTYXHIKMN")
LISU = ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU")
#: Characters that take up no room (ignorable by default), as ranges of code points.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Characters that show exactly the characters of their compatibility form: micro sign, digraphs, dots, primes,
#: doubled marks, degrees, Roman numerals, numbers with brackets or a full stop, radicals, ligatures.
SAME_SHAPE_FORMS = (
    (0x00B5, 0x00B5), (0x0132, 0x0133), (0x013F, 0x0140), (0x0149, 0x0149), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026), (0x2033, 0x2034), (0x2036, 0x2037), (0x203C, 0x203C),
    (0x2047, 0x2049), (0x2057, 0x2057), (0x2103, 0x2103), (0x2109, 0x2109), (0x2160, 0x217F), (0x2474, 0x24B5), (0x2A74, 0x2A76), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5),
    (0xFB00, 0xFB06), (0xFB13, 0xFB17),
)


@cache
def mapping() -> dict[str, str]:
    """Character to one or more characters: forms of width and face, ligatures, unbreakable blanks, same-shape letters."""
    scripts = (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU)
    same = dict(zip("".join(a for a, _ in scripts), "".join(b for _, b in scripts)))
    listed = {p for a, b in SAME_SHAPE_FORMS for p in range(a, b + 1)}
    # The next form of a character only: a full-width macron is a macron, not a blank with an accent.
    step = {"‐": "-", "‑": "-", "\xa0": " ", "\u2007": " ", "\u202f": " ", **same}
    for p in range(0x80, sys.maxunicode + 1):
        tag, *codes = (unicodedata.decomposition(chr(p)) or "-").split()
        if tag in ("<wide>", "<narrow>", "<font>") or (tag == "<compat>" and p in listed):
            step.setdefault(chr(p), "".join(chr(int(c, 16)) for c in codes))
    # Letters composed of such a letter and accents; what has no composed Latin form keeps its script.
    for p in (*range(0x0370, 0x0530), *range(0x1F00, 0x2000)):
        d = unicodedata.normalize("NFD", chr(p))
        if len(d) > 1 and d[0] in same and len(n := unicodedata.normalize("NFC", same[d[0]] + d[1:])) == 1:
            step.setdefault(chr(p), n)

    def settled(text: str) -> str:
        return "".join(settled(step[c]) if c in step else c for c in text)

    hidden = [range(a, b + 1) for a, b in INVISIBLE]
    return {c: settled(t) for c, t in step.items() if not any(ord(c) in r for r in hidden)}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(column: str) -> str:
    """The SQL expression that folds a text column."""
    # translate reads its table for every text: forms that few texts have are looked up in those texts only.
    usual, rare, several = {}, {}, {}
    for c, t in mapping().items():
        (several if len(t) > 1 else rare if unicodedata.decomposition(c).startswith(("<font>", "<compat>")) or "\u0530" <= c < "\u1f00" or "\u2c80" <= c < "\u3000" or "\ua4d0" <= c < "\ua500" else usual)[c] = t
    pick = lambda chars: _quote("[" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]")
    translated = lambda x, t: f"translate({x}, {_quote(''.join(t))}, {_quote(''.join(t.values()))})"
    invisible = _quote("[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in INVISIBLE) + "]")
    forms = f"MAP([{', '.join(map(_quote, several))}], [{', '.join(map(_quote, several.values()))}])"
    spelled = f"array_to_string(list_transform(string_split({column}, ''), lambda c: coalesce({forms}[c], c)), '')"
    shown = f"CASE WHEN regexp_matches({column}, {pick([*several, *rare])}) THEN {translated(spelled, rare)} ELSE {column} END"
    folded = f"nfc_normalize({translated(f"nfc_normalize(regexp_replace({shown}, {invisible}, '', 'g'))", usual)})"
    # As many bytes as characters: ASCII.
    return f"CASE WHEN strlen({column}) = length({column}) THEN {column} ELSE {folded} END"


#: A visible character: anything but white space and control characters.
VISIBLE = r"[^\s\x{0}-\x{20}\x{7F}-\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"


def _batches(df: DataFrame, key: str, text: str, select: str, schema: str, kind: pa.Schema) -> DataFrame:
    """Run `select` over (key, t) in DuckDB, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute("SET memory_limit = '512MB'")
        for b in batches:
            rows = pa.table([b.column(0), b.column(1)], names=["key", "t"])
            con.register("batch", rows)
            yield from con.sql(select).to_arrow_table().cast(kind).to_batches()
            con.unregister("batch")
        con.close()

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def folded_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key (bigint) and folded: the consistent form of every row's text; null stays null, empty stays empty."""
    kind = pa.schema([("key", pa.int64()), ("folded", pa.string())])
    return _batches(df, key, text, f"SELECT key, {fold_sql('t')} AS folded FROM batch", "key bigint, folded string", kind).withColumnRenamed("key", key)


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key, folded and exact: SHA-256 of the folded and of the original text, where a character is visible."""
    kind = pa.schema([("key", pa.int64()), ("folded", pa.binary()), ("exact", pa.binary())])
    select = f"""SELECT key, unhex(sha256(f)) AS folded, unhex(sha256(t)) AS exact
        FROM (SELECT key, t, {fold_sql("t")} AS f FROM batch WHERE t IS NOT NULL) WHERE regexp_matches(f, '{VISIBLE}')"""
    return _batches(df, key, text, select, "key bigint, folded binary, exact binary", kind).withColumnRenamed("key", key)


def lookalike_classes(marked: DataFrame) -> DataFrame:
    """folded, exact, n, n_texts: the distinct texts of every form that has more than one, with their documents."""
    texts = marked.groupBy("folded", "exact").agg(F.count(F.lit(1)).alias("n"))
    # Combined map-side: a form contributes a count per task, however many texts it has.
    several = texts.groupBy("folded").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    return texts.join(several, "folded")


def class_sizes(df: DataFrame, key: str, text: str) -> DataFrame:
    """class_id, n_texts, n_rows, n_pairs of every form that more than one text has.

    class_id is the SHA-256 of the form in hexadecimal; n_pairs: the pairs of rows with different texts of the form.
    This is what lookalike_pairs counts, without writing pairs: its size is that of the input at most.
    """
    texts = digests(df, key, text).groupBy("folded", "exact").agg(F.count(F.lit(1)).alias("n"))
    per = texts.groupBy("folded").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("n")).alias("squares")).where("n_texts > 1")
    pairs = (F.col("n_rows") * F.col("n_rows") - F.col("squares")) / 2
    return per.select(F.lower(F.hex("folded")).alias("class_id"), "n_texts", "n_rows", pairs.cast("bigint").alias("n_pairs"))


def lookalike_pairs(df: DataFrame, key: str, text: str, hot: int = 5000, salts: int = 64) -> DataFrame:
    """key_a < key_b of all pairs of rows whose texts look the same but are not the same string.

    Null texts and texts without a visible character make no pair; rows of equal text make none with
    each other, and are not compared: pairs are formed between distinct texts of one form, then each is
    joined with its documents. A form with more than `hot` texts, and the documents of a text with more than
    `hot` copies, are spread over salted tasks. Keys are whole numbers and unique.
    """
    marked = cut(digests(df, key, text)).select("folded", "exact", F.col(key).alias("key"))
    classes = cut(lookalike_classes(marked))
    number = classes.count()
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    many = F.col("n_texts") > hot
    a = classes.select("folded", F.col("exact").alias("exact_a"), F.col("n").alias("n_a"), F.when(many, spread("exact")).otherwise(0).alias("part"))
    b = classes.select("folded", F.col("exact").alias("exact_b"), F.col("n").alias("n_b"), F.explode(F.when(many, every).otherwise(F.array(F.lit(0)))).alias("part"))
    # Distinct texts of one form; the text with more documents is called a.
    bigger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("exact_a") < F.col("exact_b")))
    linked = cut(a.join(b, ["folded", "part"]).where(bigger).select("exact_a", "n_a", "exact_b"))
    # Documents of a: those of a hot text are spread by their key, its links repeated for every salt.
    texts_a = linked.select(F.col("exact_a").alias("exact"), F.col("n_a").alias("n")).distinct()
    docs_a = join_small(marked.select("exact", "key"), texts_a, ["exact"], number)
    docs_a = docs_a.select(F.col("exact").alias("exact_a"), F.col("key").alias("x"), F.when(F.col("n") > hot, spread("key")).otherwise(0).alias("salt"))
    links = linked.withColumn("salt", F.explode(F.when(F.col("n_a") > hot, every).otherwise(F.array(F.lit(0)))))
    first = links.join(docs_a, ["exact_a", "salt"]).select("x", "exact_b", F.when(F.col("n_a") > hot, spread("x")).otherwise(-1).alias("salt"))
    # Documents of b meet each x: repeated for every salt only where a hot text is among the partners.
    texts_b = linked.groupBy(F.col("exact_b").alias("exact")).agg(F.max("n_a").alias("most"))
    docs_b = join_small(marked.select("exact", "key"), texts_b, ["exact"], number)
    reach = F.when(F.col("most") > hot, F.concat(F.array(F.lit(-1)), every)).otherwise(F.array(F.lit(-1)))
    docs_b = docs_b.select(F.col("exact").alias("exact_b"), F.col("key").alias("y"), F.explode(reach).alias("salt"))
    both = first.join(docs_b, ["exact_b", "salt"])
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
