"""Record keys, label vectors and class constants."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Diagnosis code to class name.
CODES = {
    "164889003": "AF",
    "164890007": "AFL",
    "6374002": "BBB",
    "426627000": "Brady",
    "270492004": "IAVB",
    "59118001": "RBBB",
    "713427006": "CRBBB",
    "713426002": "IRBBB",
    "164909002": "LBBB",
    "733534002": "CLBBB",
    "39732003": "LAD",
    "445118002": "LAnFB",
    "164947007": "LPR",
    "251146004": "LQRSV",
    "111975006": "LQT",
    "698252002": "NSIVCB",
    "426783006": "NSR",
    "284470004": "PAC",
    "10370003": "PR",
    "365413008": "PRWP",
    "427172004": "PVC",
    "164917005": "QAb",
    "47665007": "RAD",
    "427393009": "SA",
    "426177001": "SB",
    "427084000": "STach",
    "63593006": "SVPB",
    "164934002": "TAb",
    "59931005": "TInv",
    "17338001": "VPB",
}
#: The 27 target classes, in order.
CLASSES = [
    "AF", "AFL", "BBB", "Brady", "LBBB", "RBBB", "1dAVb", "LAD", "LAnFB", "LPR", "LQRSV", "LQT", "NSIVCB", "NSR",
    "PAC", "PR", "PRWP", "PVC", "QAb", "RAD", "SA", "SB", "ST", "SVPB", "TAb", "TInv", "VPB",
]
#: Classes that merge or rename what the codes name.
MERGED = {"1dAVb": ["IAVB"], "ST": ["STach"], "RBBB": ["RBBB", "CRBBB", "IRBBB"], "LBBB": ["LBBB", "CLBBB"]}


def strip(text: Column) -> Column:
    """text without blanks, tabs and line ends at either side."""
    return F.regexp_replace(text, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")


def normalize_id(df: DataFrame, name: str) -> Column:
    """Bytes are decoded as they are; any other value becomes a trimmed string."""
    kind = df.schema[name].dataType.typeName()
    return F.decode(F.col(name), "UTF-8") if kind == "binary" else strip(F.col(name).cast("string"))


def derive_labels(codes: Column) -> Column:
    """array<string> of codes -> array<boolean> in CLASSES order. Unknown codes mean nothing; SB rules out Brady."""
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    names = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.element_at(known, strip(c)))
    names = F.array_compact(names)

    def label(c: str, names: Column) -> Column:
        said = F.arrays_overlap(names, F.array(*[F.lit(x) for x in MERGED.get(c, [c])]))
        return said & ~F.array_contains(names, "SB") if c == "Brady" else said

    # the names are looked up once, not for each class
    return F.get(F.transform(F.array(names), lambda n: F.array(*[F.coalesce(label(c, n), F.lit(False)) for c in CLASSES])), F.lit(0))


def conform_labels(df: DataFrame, classes: list[str]) -> DataFrame:
    """Every class as float: absent and null are 0, numbers are truncated, text raises."""
    def of(c: str) -> Column:
        if c not in df.columns:
            return F.lit(0.0)
        return F.coalesce(F.col(f"`{c}`").cast("int").cast("float"), F.lit(0.0).cast("float"))

    return df.select(*[x for x in df.columns if x not in classes], *[of(c).cast("float").alias(c) for c in classes])


def parse_true(value: Column) -> Column:
    """1 for the text true in any case, 0 for all else, null included."""
    return F.when(F.lower(strip(value.cast("string"))) == "true", 1).otherwise(0)


def rename_normal(df: DataFrame, collection: str = "collection") -> DataFrame:
    """In collection D2 normal_ecg becomes class NSR."""
    nsr = F.col("NSR") if "NSR" in df.columns else F.lit(None).cast(df.schema["normal_ecg"].dataType)
    merged = F.when(F.col(collection) == "D2", F.coalesce(F.col("normal_ecg"), nsr)).otherwise(nsr)
    return df.select(*[c for c in df.columns if c not in ("NSR", "normal_ecg")], merged.alias("NSR"))


def class_weights(meta: DataFrame, classes: list[str], present: str = "source_classes") -> DataFrame:
    """class, total, positives, pos_weight. A row counts for the classes that its file has (column `present`)."""
    of = [F.struct(F.lit(c).alias("class"), F.col(f"`{c}`").cast("string").alias("v")) for c in classes]
    cells = meta.select(present, F.explode(F.array(*of)).alias("x")).filter(F.array_contains(F.col(present), F.col("x.class")))
    found = cells.groupBy(F.col("x.class").alias("class")).agg(F.count("*").alias("total"), F.sum(parse_true(F.col("x.v"))).cast("long").alias("positives"))
    names = meta.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    found = names.join(found, "class", "left").na.fill(0, ["total", "positives"])
    weight = F.when(F.col("total") == 0, 1.0).when(F.col("positives") == 0, F.col("total").cast("double")).otherwise((F.col("total") - F.col("positives")) / F.col("positives"))
    return found.withColumn("pos_weight", F.round(weight, 6)).withColumn("sqrt_weight", F.round(F.sqrt("pos_weight"), 6))
