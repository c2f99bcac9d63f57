"""docsnap keeps a table of documents in step with a tree of files, on Spark.

The entry points are ``docsnap.plans.crawl.crawl``, ``docsnap.plans.store.DocumentStore`` and
``docsnap.streaming.events.follow_events``; ``docsnap.options.CrawlOptions`` configures them.
"""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
