"""License scan in DataFrame functions only.

Texts and templates are lower-cased, everything but a-z and 0-9 separates words, and shingles are WIDTH
words long.  Windows of as many shingles as a size class (powers of two), a quarter of it apart, run
over the whole text; a template is looked up in the class of its own length.  Each of BANDS MinHash
values is a band: a window retrieves a template with which it shares one.  A window over an embedded
template shares at least 4/9 of the shingles of both with it, so it is missed with a chance
of (5/9)^16, under 1 in 10,000, and a template of one shingle never is.  What is retrieved
is verified by exact containment: the share of the template's shingles that the text holds must be
num/den.

A window can only retrieve a template if it holds the template's shingle of the least hash in some
band, so texts without any of these few shingles need no windows; the templates are a fixed,
short list (at most 200), which bounds what is broadcast.

Results for special cases: texts that are null, empty or shorter than a shingle match nothing; repeated
rows match each on their own (counted once for an id); null ids are passed on; an empty table
gives no rows; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, BANDS = 5, 16

#: Statements by which texts name their license (fixed values: the customary wording of each).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def let(value: Column, then) -> Column:
    """then(value) with value computed once: inside a lambda an expression is computed for every element, a variable isn't."""
    return F.transform(F.array(value), then)[0]


def shingles(text: Column) -> Column:
    """Hashes of the shingles in order; empty for fewer than WIDTH words."""
    empty = F.array().cast("array<bigint>")
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda k: F.xxhash64(*(F.get(w, k + j) for j in range(WIDTH))))
    return F.coalesce(let(words(text), lambda w: F.when(F.size(w) >= WIDTH, hashed(w)).otherwise(empty)), empty)


def under(band: int):
    """The hash function of a band, for transform(): it must have one parameter, or it gets the position as well."""
    return lambda x: F.xxhash64(x, F.lit(band))


def placed(band: int):
    return lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("v"), x.alias("h"))


def signature(hashes: Column) -> Column:
    """The least value under each of the BANDS hash functions, marked with its band."""
    return F.array(*(F.xxhash64(F.array_min(F.transform(hashes, under(b))), F.lit(b)) for b in range(BANDS)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_found, n_template: templates of which the text holds at least num/den of the distinct shingles."""
    if len(templates) > 200:
        raise ValueError("at most 200 templates")
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, body string").select("license", shingles(F.col("body")).alias("h"))
    known = known.where("size(h) > 0").withColumn("class", F.expr("cast(power(2, ceil(log2(size(h)))) as int)"))
    rows = known.select(
        "license", "class", F.array_distinct("h").alias("template"), signature(F.col("h")).alias("bands"),
        F.array(*(F.array_min(F.transform("h", placed(b)))["h"] for b in range(BANDS))).alias("least"),
    ).collect()  # as many rows as templates
    if not rows:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0).alias("n_found"), F.lit(0).alias("n_template")).where("false")
    least = sorted({h for r in rows for h in r["least"]})
    table = spark.createDataFrame([(r["license"], r["class"], r["template"], b) for r in rows for b in r["bands"]], "license string, class int, template array<bigint>, band long")
    # explode() of one element keeps the optimizer from computing the shingles once for the filter and once for the result
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.array(shingles(F.col(text_col).cast("string")))).alias("h"))
    own = own.where(F.arrays_overlap("h", F.array(*map(F.lit, least))))
    classes = F.explode(F.array(*(F.lit(c) for c in sorted({r["class"] for r in rows}))))
    starts = F.explode(F.sequence(F.lit(1), F.size("h"), F.greatest(F.col("class").bitwiseAND(F.lit(~3)) / 4, F.lit(1)).cast("int")))
    window = own.select("doc_id", "h", classes.alias("class")).select("doc_id", "h", "class", starts.alias("start"))
    window = window.withColumn("w", F.slice("h", F.col("start"), F.col("class"))).where(F.arrays_overlap("w", F.array(*map(F.lit, least))))
    bands = window.select("doc_id", "h", "class", F.explode(let(F.col("w"), signature)).alias("band"))
    found = bands.join(F.broadcast(table), ["class", "band"]).select("doc_id", "license", F.size(F.array_intersect("template", "h")).alias("n_found"), F.size("template").alias("n_template"))
    found = found.where(F.col("n_found") * den >= F.col("n_template") * num)
    return found.groupBy("doc_id", "license").agg(F.max("n_found").alias("n_found"), F.max("n_template").alias("n_template"))


def sql(templates: dict[str, str] = TEMPLATES, num: int = 4, den: int = 5) -> str:
    """The same by comparing every text with every template (for DuckDB over the view documents)."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    split = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')".format
    shingled = f"unnest(list_distinct([array_to_string(w[k : k + {WIDTH - 1}], ' ') for k in range(1, len(w) - {WIDTH - 2})]))"
    return f"""
        WITH t(license, body) AS (VALUES {values}),
        tw AS MATERIALIZED (SELECT license, {split('body')} AS w FROM t),
        dw AS MATERIALIZED (SELECT DISTINCT doc_id, {split('text')} AS w FROM documents),
        known AS MATERIALIZED (SELECT license, {shingled} AS s FROM tw),
        size AS (SELECT license, count(*) AS n_template FROM known GROUP BY license),
        own AS (SELECT doc_id, {shingled} AS s FROM dw)
        SELECT doc_id, license, CAST(count(*) AS INTEGER) AS n_found, CAST(any_value(n_template) AS INTEGER) AS n_template
        FROM own JOIN known USING (s) JOIN size USING (license)
        GROUP BY doc_id, license HAVING count(*) * {den} >= any_value(n_template) * {num}
    """
