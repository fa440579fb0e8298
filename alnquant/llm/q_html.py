"""Registered query of operator 7."""

from . import common as C
from . import html_text


def op7_html_extraction(spark, sf_dir):
    return html_text.extract(C.read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
