"""All queries outside the llm subpackage, and their SQL."""

from . import io, pipeline, reference, reference_sql

QUERIES = {**reference.QUERIES, **io.QUERIES, **pipeline.QUERIES}
SQL = {**reference_sql.SQL, **io.SQL, **pipeline.SQL}
