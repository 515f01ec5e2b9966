"""Beyond the batch analyses: traces cut and watched as events arrive."""
