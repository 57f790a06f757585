"""python -m rasterbrook test|decode|convert: parse files and list what is wrong, count decoded pixels, or convert to another format."""

import argparse

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rasterbrook.sources import datasource, images


def relative_name(spark: SparkSession, root: str) -> Column:
    """The column path below root, without its extension: a file's folders are kept."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/+", "file:/")
    inside = F.when(path.startswith(whole), F.substring(path, len(whole) + 1, 1 << 30)).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))
    return F.regexp_replace(inside, r"(?<=[^/])\.[^./]*$", "")


def main() -> int:
    parser = argparse.ArgumentParser(prog="rasterbrook", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("test", "decode"):
        sub.add_parser(name).add_argument("path")
    convert = sub.add_parser("convert")
    convert.add_argument("path")
    convert.add_argument("target")
    convert.add_argument("--to", choices=["bmp", "jpeg"], default="bmp")
    convert.add_argument("--quality", type=int, default=90)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("rasterbrook").getOrCreate()
    decoded = images.decode(images.files(spark, args.path))
    if args.command == "convert":
        datasource.register(spark)
        rows = decoded.filter("error IS NULL").select(relative_name(spark, args.path).alias("name"), "width", "height", "data")
        rows.write.format(args.to).option("quality", args.quality).mode("append").save(args.target)
    elif args.command == "decode":
        decoded.select("path", "format", "width", "height", (F.octet_length("data") / 3).cast("long").alias("pixels"), "error").show(1000, False)
    bad = decoded.filter("error IS NOT NULL").select("path", "error")
    bad.show(1000, False)
    return int(not bad.isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
