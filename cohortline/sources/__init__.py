from cohortline.sources.files import (load_raw, read_clean, read_clean_csv, read_raw_csv, write_clean,
                                      write_csv)
from cohortline.sources.fixture import city_country_lookup, raw_files, raw_orders
from cohortline.sources.testdata import table

__all__ = ["load_raw", "read_clean", "read_clean_csv", "read_raw_csv", "write_clean", "write_csv",
           "city_country_lookup", "raw_files", "raw_orders", "table"]
