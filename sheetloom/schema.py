"""Record types that travel between stages. Sentinels (0, "") stand at the edges only; inside, unknown is null."""

from pyspark.sql import types as T

_s, _d, _i, _l, _b = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TEXT_ITEM = _struct(job_id=_l, ord=_l, handle=_s, kind=_s, place=_s, layer=_s, style=_s, raw=_s, plain=_s, lang=_s, height=_d, width_factor=_d, rotation=_d, x=_d, y=_d, vertical=_b, block_owner=_s, tag=_s, box_width=_d, halign=_i, ax=_d)
RULE = _struct(job_id=_l, place=_s, axis=_s, pos=_d, lo=_d, hi=_d)
ENTITY = _struct(job_id=_l, space=_s, ord=_l, type=_s, handle=_s, layer=_s, style=_s, text=_s, flags=_i, height=_d, x=_d, y=_d, attribs=T.ArrayType(_struct(tag=_s, text=_s)), cells=T.ArrayType(_s), vertices=T.ArrayType(_struct(x=_d, y=_d)), closed=_b)
SPAN = _struct(job_id=_l, page=_i, ord=_l, text=_s, size=_d, x0=_d, x1=_d, y0=_d, y1=_d)
TRANSLATION = _struct(id=_s, target=_s, ok=_b, note=_s)
REVIEW = _struct(id=_s, text=_s, approved=_b, width_factor=_d)
MEMORY = _struct(source=_s, target=_s, layer=_s)
USAGE = _struct(job_id=_l, at=T.TimestampNTZType(), model=_s, input=_l, output=_l, cache_read=_l, cache_write=_l)
PRICING = _struct(model=_s, input=_d, output=_d, cache_read=_d, cache_write=_d)
JOB = _struct(id=_s, client=_s, project=_s, status=_s, deleted_at=T.TimestampNTZType(), flags=T.MapType(_s, _s), usage_log=T.ArrayType(_struct(at=_s, model=_s, input=_l, output=_l, cache_read=_l, cache_write=_l)))
