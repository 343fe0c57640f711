"""Column expressions. All built-in Spark functions: no Python UDFs."""

from rollcall.functions.dates import (  # noqa: F401
    as_date, day_sequence, format_day, iso_text, next_day, parse_date,
)
from rollcall.functions.logic import CATEGORY_DEFAULT, CATEGORY_RULES, category, if_else  # noqa: F401
from rollcall.functions.text import remove_first, title_case  # noqa: F401
