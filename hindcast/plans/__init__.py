"""End-to-end plans: preprocessing, task generation, prediction, evaluation, registered queries."""
