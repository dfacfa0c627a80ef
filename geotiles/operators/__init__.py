"""Query operators over keyed points."""
