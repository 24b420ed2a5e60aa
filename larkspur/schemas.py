"""Explicit schemas: nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ITEM = _struct(
    externalId=_S, externalSource=_S, externalType=_S, externalUpdatedAt=_S, name=_S, description=_S, salePriceKopecks=_L, categoryPath=_S, isVisible=_B, rangForApp=_I,
    imageUrls=T.ArrayType(_S), groupImageKeys=T.ArrayType(_S), relatedServices=T.ArrayType(_struct(id=_S, name=_S, kind=_S)), relatedComponents=T.ArrayType(_struct(id=_S, name=_S)),
    contentForEmbedding=_S, contentHash=_S, attributes=T.MapType(_S, _S),
)
SNAPSHOT = _struct(syncMode=_S, sourceSystem=_S, syncedAt=_S, items=T.ArrayType(ITEM))
