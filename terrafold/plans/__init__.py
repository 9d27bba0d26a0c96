"""Query modules; importing this package registers them."""

from terrafold.plans import files, incidents, measures, networks, places, relations, scorecard, statistics, streams, texts  # noqa: F401
