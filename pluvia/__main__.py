"""Command line: python -m pluvia --stage all --work DIR --tracks-csv FILE --fields TABLE."""

from __future__ import annotations

import argparse
from dataclasses import fields as dataclass_fields

from .operators.audit import passed
from .plans.audits import AUDITS, report
from .plans.workflow import REPLACE, SECTIONS, STAGES, Settings, run
from .session import session


def main() -> None:
    p = argparse.ArgumentParser(prog="pluvia", description="Storm-associated rainfall extremes: workflow stages.")
    p.add_argument("--stage", choices=[REPLACE, *STAGES, "all"], default="all")
    p.add_argument("--audit", choices=AUDITS, help="report on inputs or outputs instead of running a stage; failures end with status 1")
    p.add_argument("--expected", default="", help="JSON of published numbers, for --audit release")
    p.add_argument("--intervals", action="store_true", help="make bootstrap intervals anew for --audit release")
    p.add_argument("--work", required=True)
    p.add_argument("--tracks-csv", default="")
    p.add_argument("--fields", default="", help="long Parquet table of fields")
    p.add_argument("--overrides", default="", help="fields that replace time steps of the source")
    p.add_argument("--first", type=int, default=1980)
    p.add_argument("--last", type=int, default=2023)
    p.add_argument("--outer-km", type=float, default=Settings.outer_km)
    p.add_argument("--centre-km", type=float, default=Settings.centre_km)
    p.add_argument("--repetitions", type=int, default=Settings.repetitions)
    p.add_argument("--block-years", type=int, default=Settings.block_years)
    p.add_argument("--seed", type=int, default=Settings.seed)
    p.add_argument("--storms", nargs="*", default=[])
    p.add_argument("--max-times", type=int)
    p.add_argument("--start-time", default="", help="tracks from this UTC time on")
    p.add_argument("--end-time", default="", help="tracks up to this UTC time")
    p.add_argument("--netcdf", action="store_true", help="fields and overrides are folders of NetCDF files")
    p.add_argument("--variable", default=Settings.variable, help="the NetCDF variable")
    p.add_argument("--partial", action="store_true", help="the archive may lack time steps")
    p.add_argument("--land", default="", help="table of the rows on land, for the surface section")
    p.add_argument("--sections", nargs="+", choices=SECTIONS, default=list(SECTIONS))
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--resume", action="store_true", help="keep the histograms of years that are there, and add the others in order")
    a = vars(p.parse_args())
    a["storms"], a["sections"] = tuple(a["storms"]), tuple(a["sections"])
    settings = Settings(**{f.name: a[f.name] for f in dataclass_fields(Settings)})
    if not a["audit"]:
        run(session(), settings, a["stage"])
        return
    found = report(session(), settings, a["audit"])
    found.show(1000, truncate=False)
    raise SystemExit(0 if passed(found) else 1)


if __name__ == "__main__":
    main()
