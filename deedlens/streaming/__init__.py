"""deedlens.streaming"""
