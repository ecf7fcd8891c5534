"""statutegrid: regulatory-text analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

from statutegrid.operators.pipeline import analysed, run  # noqa: E402
from statutegrid.operators.review import COLUMNS  # noqa: E402
from statutegrid.sources.datasources import read_reported, write_workbooks  # noqa: E402
from statutegrid.sources.readers import read_blocks  # noqa: E402
from statutegrid.sources.sinks import write_analysis, write_tables, write_workbook  # noqa: E402

__all__ = ["COLUMNS", "analysed", "read_blocks", "read_reported", "run", "write_analysis", "write_tables", "write_workbook", "write_workbooks"]
