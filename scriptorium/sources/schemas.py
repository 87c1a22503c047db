"""Schemas of the inputs. Absent fields are null."""

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructType

_S, _L, _I, _B = StringType(), LongType(), IntegerType(), BooleanType()

CATEGORY = StructType().add("category", _S).add("sortkey", _S).add("missing", _B)
LINK = StructType().add("ns", _I).add("title", _S).add("exists", _B)
SECTION = StructType().add("level", _S).add("line", _S).add("anchor", _S)
PARSE = StructType().add("text", _S).add("displaytitle", _S).add("categories", ArrayType(CATEGORY)).add("links", ArrayType(LINK)).add("images", ArrayType(_S)).add("sections", ArrayType(SECTION))
PAGE = StructType().add("pageid", _L).add("ns", _I).add("title", _S).add("captured_at", _S).add("parse", PARSE)
META_PAGE = StructType().add("pageid", _L).add("ns", _I).add("title", _S).add("is_redirect", _B)
METADATA = StructType().add("captured_at", _S).add("pages", ArrayType(META_PAGE)).add("redirect_map", MapType(_S, _S)).add("ns_counts", MapType(_S, _L))
WIKITEXT = StructType().add("pageid", _L).add("ns", _I).add("title", _S).add("revid", _L).add("wikitext", _S)
