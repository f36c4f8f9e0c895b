"""All registered queries and their SQL."""

from . import charts, columns, extra, formats, further, genomes, more, sequences

QUERIES, SQL = {}, {}
for _module in (charts, sequences, more, extra, further, genomes, formats, columns):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
