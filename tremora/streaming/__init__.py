"""No operator here streams: lateness is a filter on when an event became available (operators/filters.py), over batch
tables. ``available_day`` would be the event time of a stream."""
