"""Run registered queries on a data folder: python tools/smoke.py FOLDER [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from termindex.plans.registered import QUERIES  # noqa: E402
from termindex.session import local_session  # noqa: E402

folder, *names = sys.argv[1:]
spark = local_session("8")
spark.sparkContext.setLogLevel("ERROR")
for name in names or QUERIES:
    begin = time.time()
    try:
        df = QUERIES[name](spark, folder)
        print(f"{name:28s} {df.count():8d} rows {time.time() - begin:6.2f} s  {df.dtypes}", flush=True)
    except Exception as error:  # report and go on with the next query
        print(f"{name:28s} FAILED {str(error)[:600]}", flush=True)
