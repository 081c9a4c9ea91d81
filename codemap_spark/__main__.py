import sys

from codemap_spark.plans.commands import main

sys.exit(main())
