"""deedlens.sources"""
