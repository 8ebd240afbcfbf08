"""Named queries over the tables, with the SQL of the same rows."""

from leafmark.plans import composite, composition, detection, elements, evaluation, layout, markup, orders, relations, results, rules, structure

PLANS = (layout, relations, evaluation, markup, composite, composition, rules, detection, structure, results, elements, orders)
