"""Paper metadata Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.text import strip

# Schema of one raw search record of the citation index.
INDEX_RECORD = (
    "paperId string, title string, authors array<struct<name:string>>, abstract string, "
    "year int, externalIds struct<ArXiv:string,DOI:string>, url string, citationCount bigint, "
    "isOpenAccess boolean, openAccessPdf struct<url:string>"
)

# Column order of normalised paper metadata.
PAPER_COLUMNS = (
    "paper_id", "title", "authors", "abstract", "year", "doi", "url", "pdf_url", "source",
    "citation_count", "full_text",
)

FULL_TEXT_MINIMUM = 100


def _given(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def paper_id(arxiv: Column, doi: Column, index_id: Column) -> Column:
    """arXiv id, else DOI, else the index's own id."""
    return F.coalesce(
        F.concat(F.lit("arxiv:"), _given(arxiv)),
        F.concat(F.lit("doi:"), _given(doi)),
        F.concat(F.lit("s2:"), F.coalesce(index_id, F.lit("unknown"))),
    )


def arxiv_id(entry_url: Column) -> Column:
    """What follows the last ``/abs/`` of an entry address."""
    return F.element_at(F.split(entry_url, "/abs/"), -1)


def title_key(title: Column) -> Column:
    return strip(F.lower(F.coalesce(title, F.lit(""))))


def has_full_text(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > FULL_TEXT_MINIMUM, F.lit(False))


def rewrite_pmc_link(href: Column) -> Column:
    """FTP links of the open-access service become HTTPS article links."""
    return F.regexp_replace(
        href,
        r"^ftp://ftp\.ncbi\.nlm\.nih\.gov/pub/pmc/",
        "https://pmc.ncbi.nlm.nih.gov/articles/",
    )


def candidate_urls(
    pdf_url: Column, pid: Column, doi: Column, pmc_url: Column, unpaywall_url: Column
) -> Column:
    """Addresses to try for a full text, in order and without repeats."""
    arxiv_pdf = F.when(
        F.startswith(pid, F.lit("arxiv:")),
        F.concat(F.lit("https://arxiv.org/pdf/"), F.substring(pid, 7, 2**31 - 1)),
    )
    with_doi = _given(doi).isNotNull()
    tried = F.array(
        _given(pdf_url),
        arxiv_pdf,
        F.when(with_doi, _given(rewrite_pmc_link(pmc_url))),
        F.when(with_doi, _given(unpaywall_url)),
    )
    return F.array_distinct(F.array_compact(tried))
