"""Structure text (fixed columns) as atom and residue tables, and annotation JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Three-letter residue codes and their letters.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M",
    "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O", "ASX": "B", "GLX": "Z",
}


#: Where a text's lines end.
LINE_END = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Ends other than a line feed.
RARE_END = "[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def letters() -> Column:
    return F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))


def atom_lines(texts: DataFrame) -> DataFrame:
    """structure_id, line_ix, line, is_atom, chain, resseq, icode, symbol from (structure_id, text).

    is_atom: the line belongs to a residue of the first model. The first model ends at a second MODEL line, or at an
    ENDMDL line if there was a MODEL line before. Alternate locations other than blank, A and 1, unknown residue codes
    (water, ligands) and lines of fewer than 27 characters belong to no residue.
    """
    # A text is one row, so where its first model ends is known before its lines part: nothing is shuffled or sorted.
    body = F.concat(F.expr("left(text, length(text) - 4)"), F.regexp_replace(F.expr("right(text, 4)"), f"(?:{LINE_END})$", ""))
    rows = texts.select("structure_id", body.alias("text"))
    rows = rows.select("structure_id", F.when(F.rlike("text", F.lit(RARE_END)), F.split("text", LINE_END)).otherwise(F.split("text", "\n")).alias("lines"))
    model = lambda x: F.startswith(x, F.lit("MODEL"))
    # The few MODEL lines by their places and ENDMDL lines by -1 - place; from them -2: no model yet, -1: it doesn't end.
    marks = F.filter(F.transform("lines", lambda x, i: F.when(F.startswith(x, F.lit("MODEL")), i).when(F.startswith(x, F.lit("ENDMDL")), -1 - i)), lambda m: m.isNotNull())
    over = F.aggregate(marks, F.lit(-2), lambda a, m: F.when(a >= 0, a).when(a == -1, F.greatest(m, -1 - m)).when(m >= 0, -1).otherwise(-2))
    # Outer, since Spark would otherwise build and split every text once more to filter by the number of its lines.
    lines = rows.withColumn("over", over).select("structure_id", "over", F.posexplode_outer("lines").alias("line_ix", "line")).where("line is not null")
    in_first = (F.col("over") < 0) | (F.col("line_ix") < F.col("over"))
    cut = lambda a, b: F.substring("line", a, b)
    resseq, symbol = F.trim(cut(23, 4)).try_cast("int"), F.try_element_at(letters(), F.upper(F.trim(cut(18, 3))))
    atom = cut(1, 6).isin("ATOM  ", "HETATM") & (F.length("line") >= 27) & cut(17, 1).isin(" ", "A", "1") & in_first
    rows = lines.select("structure_id", "line_ix", "line", F.trim(cut(22, 1)).alias("chain"), resseq.alias("resseq"), F.trim(cut(27, 1)).alias("icode"), symbol.alias("symbol"), atom.alias("atom"))
    is_atom = F.col("atom") & F.col("symbol").isNotNull() & F.col("resseq").isNotNull()
    return rows.select("structure_id", "line_ix", "line", is_atom.alias("is_atom"), "chain", "resseq", "icode", "symbol")


def chain_residues(atoms: DataFrame) -> DataFrame:
    """structure_id, chain, subject_pos (from 1), resseq, icode, symbol: consecutive lines of one residue key are one residue."""
    rows = atoms.where("is_atom")
    along = Window.partitionBy("structure_id", "chain").orderBy("line_ix")
    key = F.struct("resseq", "icode")
    first = rows.withColumn("before", F.lag(key).over(along)).where(F.col("before").isNull() | (F.col("before") != key))
    return first.select("structure_id", "chain", F.row_number().over(along).alias("subject_pos"), "resseq", "icode", "symbol")


def chain_sequences(residues: DataFrame) -> DataFrame:
    """structure_id, chain, sequence."""
    at = F.array_sort(F.collect_list(F.struct("subject_pos", "symbol")))
    return residues.groupBy("structure_id", "chain").agg(F.array_join(at["symbol"], "").alias("sequence"))


def annotated_lines(atoms: DataFrame, scores: DataFrame) -> DataFrame:
    """structure_id, line_ix, line: columns 61-66 of a residue's lines hold its score with two decimals, -1 without one.

    Such lines are filled with blanks to 80 columns; lines that belong to no residue stay as they are.
    scores: structure_id, chain, resseq, icode, score.
    """
    joined = atoms.join(scores, ["structure_id", "chain", "resseq", "icode"], "left")
    rows = joined.select("structure_id", "line_ix", "is_atom", "line", "score", F.rpad("line", F.greatest(F.length("line"), F.lit(80)), F.lit(" ")).alias("wide"))
    new = F.concat(F.substring("wide", 1, 60), F.format_string("%6.2f", F.coalesce("score", F.lit(-1.0))), F.expr("substring(wide, 67)"))
    return rows.select("structure_id", "line_ix", F.when(F.col("is_atom"), new).otherwise(F.col("line")).alias("line"))


def cross_references(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """From annotation JSON, a file (or with multi_line False a line) each: protein_id, structure_ids the identifiers of the
    regions' cross references to the structure bank, upper case, distinct, sorted."""
    schema = "acc string, accession string, regions array<struct<cross_refs:array<struct<db:string,id:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    refs = F.flatten(F.transform(F.coalesce("regions", F.array().cast("array<struct<cross_refs:array<struct<db:string,id:string>>>>")), lambda r: F.coalesce(r["cross_refs"], F.array().cast("array<struct<db:string,id:string>>"))))
    ids = F.array_sort(F.array_distinct(F.transform(F.filter(refs, lambda x: (F.upper(x["db"]) == "PDB") & (F.trim(x["id"]) != "")), lambda x: F.upper(F.trim(x["id"])))))
    return rows.select(F.coalesce("acc", "accession").alias("protein_id"), ids.alias("structure_ids"))
